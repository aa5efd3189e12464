"""Vocabulary that hints at pages without content, and the forms of unfilled values.

Single words, not wordings: they are weak evidence that the statistics of the
corpus have to bear out. Words are compared in lower case; ``*`` stands for any
run of characters outside ASCII, whether or not a wrong charset changed them.
"""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: What a message of a server or site speaks about: en de fr es it pt nl.
THINGS = _set("""
page pages site website server servers request requests service link url address resource session connection connect gateway database host file document database account access browser browsers network settings configuration
seite seiten server anfrage dienst link adresse sitzung verbindung datenbank zugriff datei dokument browser browsers einstellungen netz
page serveur demande requ*te service lien adresse session connexion connecter acc*s fichier base navigateur r*glages param*tres
p*gina sitio navegador configuraci*n ajustes servidor solicitud petici*n servicio enlace direcci*n sesi*n conexi*n acceso archivo recurso base
pagina server richiesta servizio collegamento indirizzo sessione connessione accesso risorsa sito impostazioni
servi*o sess*o liga*o acesso endere*o pedido
verzoek dienst koppeling adres sessie verbinding toegang bestand
""")

#: What went wrong.
FAILURES = _set("""
error errors not found find couldn't can't cannot could didn't doesn't don't isn't unable unavailable denied forbidden expired failed failure wrong invalid refused blocked unauthorized maintenance timeout timed
moved renamed deleted removed gone exist exists longer unusual unexpected bad broken sorry oops temporarily problem uncaught exception traceback fatal warning too many down offline interrupted outdated again later
fehler nicht gefunden verweigert abgelaufen wartungsarbeiten wartung ung*ltig gesperrt gel*scht verschoben existiert fehlgeschlagen veraltet keine fehlt leider fehlernummer sp*ter erneut
erreur erreurs pas introuvable refus* expir*e expir* indisponible impossible maintenance invalide bloqu*e d*plac*e d*sol* n'existe n'a n'est plus plus tard r*essayez
error errores no encontrada encontrado denegado caducada caducado ocurrido disponible mantenimiento inv*lido bloqueada movido eliminada siento m*s tarde int*ntelo
errore non trovata trovato negato scaduta manutenzione esiste spostata disponibile pi* spiacenti riprova
erro encontrada negado expirada manuten*o existe indispon*vel
fout niet gevonden geweigerd verlopen onderhoud bestaat helaas onbeschikbaar
""")

#: What the reader is asked to do about it.
ACTIONS = _set("""
enable activate allow turn turned switch switched disabled activated required requires need needs needed must please reload refresh retry try contact administrator return back go sign check checking supports support run runs continue use report off on wait
aktivieren aktiviert deaktiviert einschalten erlauben ben*tigt bitte versuchen zur*ck startseite neu laden
activer activez activ* d*sactiv* autoriser n*cessite veuillez contactez l'administrateur retour accueil l'accueil recharger rechargez
activar active activado desactivado necesita habilite habilitar permita volver inicio cargarla
abilita abilitare attiva attivare disabilitato richiede necessario torna ricarica
ative ativar desativado precisa voltar inschakelen ingeschakeld uitgeschakeld nodig terug
""")

#: Scripts that the reader is asked to run.
SCRIPTS = _set("javascript scripts script scripting skripte skript skripten js noscript")

#: Words of sample texts about themselves.
SAMPLES = _set("""
sample example dummy placeholder text copy here goes paragraph heading headline title subtitle caption image column product name description layout words own replace edit click content coming soon testing body page your add write delete
blindtext platzhaltertext beispiel beispieltext beispiel*berschrift musterseite mustertext bildunterschrift absatz steht hier ihr l*schen klicken text *berschrift zum *ndern
texte remplissage exemple d'exemple titre l*gende paragraphe votre ici cliquez l'image supprimer modifier page
texto relleno ejemplo muestra t*tulo p*rrafo escriba aqu* su p*gina pie foto clic editar
testo esempio segnaposto titolo paragrafo
""")

#: Single words that can only be such a text.
CAPTIONS = _set("blindtext platzhaltertext beispieltext mustertext musterseite beispiel*berschrift bildunterschrift")

#: Notices around a page that are no part of its content.
FRAMES = _set("cookies cookie privacy consent device gdpr datenschutz confidentialit* privacidad imprint impressum copyright")

#: Filler words of printers' Latin: the usual paragraph, the vocabulary of common generators, and cut forms of it.
LATIN = _set("""
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit
voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
a ac accumsan aenean aliquam aliquet ante aptent arcu at auctor augue bibendum blandit class condimentum congue conubia convallis cras cubilia curabitur curae
cursus dapibus diam dictum dictumst dignissim dis donec dui efficitur egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus
felis fermentum feugiat finibus fringilla fusce gravida habitant habitasse hac hendrerit himenaeos iaculis imperdiet inceptos integer interdum justo lacinia lacus
laoreet lectus leo libero ligula litora lobortis luctus maecenas magnis malesuada massa mattis mauris maximus metus mi molestie mollis montes morbi mus nam
nascetur natoque nec neque netus nibh nisl nostra nullam nunc odio orci ornare parturient pellentesque penatibus per pharetra phasellus placerat platea porta
porttitor posuere potenti praesent pretium primis proin pulvinar purus quam quisque rhoncus ridiculus risus rutrum sagittis sapien scelerisque sem semper senectus
sociosqu sodales sollicitudin suscipit suspendisse taciti tellus tempus tincidunt torquent tortor tristique turpis ullamcorper ultrices ultricies urna varius
vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate
""")

#: Words typed to fill a field; keyboard mash itself is known by its letters.
MASH = _set("aaaa asdf bar blah dfgh foo hjkl jkl qwer qwerty test uiop xcvb xxx zzz")
#: Rows of the keyboards in use, along which mash is typed.
ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "asdfghjkl;", "qsdfghjklm", "zxcvbnm", "yxcvbnm", "wxcvbn")

#: Words that show a sentence is about variables, values or wordings.
EXPLAINING = _set("""
value values variable variables prints replaces template templates denotes mathematics syntax printf editors placeholder
wert variable platzhalter vorlage valeur gabarit valor plantilla
""")

MISSING_MARKS = r"#N/A|#REF!|\[object Object\]|\?\?\?\w+\?\?\?|\bmissing_translation\b|\bN/A-VALUE\b|\(null\)"
MISSING_WORDS = r"(?:null|None|NaN|undefined|nil)"
PROMPT_STARTS = r"INSERT|ADD|ENTER|YOUR|TYPE|IHR|IHRE|VOTRE|SU|INSERTE|INS\S{1,6}RER"
PROMPT_ENDS = r"GOES HERE|HERE|HIER EINF\S{1,6}GEN|ICI|AQU\S{1,4}"
#: Character entities that are no variables.
ENTITIES = "amp|lt|gt|quot|apos|nbsp|copy|reg|euro|hellip|mdash|ndash|laquo|raquo|[lr][ds]quo|auml|ouml|uuml|szlig|eacute|egrave|agrave|ccedil|ntilde"
