"""The streaming job: one parsed stream, a hot sink of windows and a cold sink of rows."""
