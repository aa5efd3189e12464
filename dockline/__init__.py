"""dockline: station-availability analytics and training-data operators on Spark DataFrames."""
