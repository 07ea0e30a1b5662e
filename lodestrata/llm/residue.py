"""Template residue, filler and error-page text in records that should hold real content.

One Aho-Corasick automaton finds all phrases of error pages, script notices and filler in several
languages in a single pass, with the marks that open template fields; a mark is followed to its
closing one. A phrase counts by how much of its segment it covers: "Access denied." is an error
page, "you design what people see when access is denied" is not. A record's coverage is the share
of its letters and digits in residue; callers exclude records by it, or all with a segment of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrases of error pages and of servers that gave no page.
ERRORS = """
page not found|page can't be found|page cannot be found|page could not be found|page does not exist|page you requested|page you are looking for
requested document does not exist|requested url was not found|does not exist on this server|not found on this server
internal server error|error code|http error|server error|bad gateway|gateway timeout|gateway time-out|bad request|upstream|timed out
service unavailable|temporarily unavailable|service temporarily unavailable|please try again in|try again later|seconds
access denied|access to this page has been denied|permission denied|forbidden|you don't have permission to access|not authorized|unauthorized|reference no
too many requests|slow down|rate limit exceeded|your session has expired|session expired|session timed out|please log in again|please sign in again|log in again to continue
something went wrong|an error occurred|an unexpected error occurred|unexpected error|while loading this position|while loading this page|failed to load|unable to load|could not be loaded
down for maintenance|site is down|under maintenance|for scheduled maintenance|undergoing scheduled maintenance|undergoing maintenance|we'll be back soon|be back shortly|checking your browser|before you can view this page|verify you are human|verifying you are human|are you a robot|complete the captcha|ray id|ray
this job is no longer available|404 error|error 404|404 not found|403 forbidden|500 internal|502 bad|503 service|request was blocked|request has been blocked|blocked by the security service|security service|oops|back to start|contact support|go back to the homepage|error the requested
seite nicht gefunden|seite wurde nicht gefunden|bitte prüfen sie die adresse|zugriff verweigert|interner serverfehler|dienst nicht verfügbar|ihre sitzung ist abgelaufen|sitzung abgelaufen|bitte melden sie sich erneut an|zu viele anfragen|ein fehler ist aufgetreten|wartungsarbeiten|versuchen sie es später|bitte versuchen sie es später erneut
page non trouvée|page introuvable|page n'existe pas|erreur interne du serveur|réessayez plus tard|veuillez réessayer plus tard|accès refusé|service indisponible|votre session a expiré|session expirée|veuillez vous reconnecter|trop de requêtes|une erreur est survenue|une erreur s'est produite|site en maintenance|vérifiez l'adresse
página no encontrada|no se encontró la página|la página no existe|error interno del servidor|acceso denegado|servicio no disponible|su sesión ha caducado|la sesión ha expirado|inicie sesión de nuevo|demasiadas solicitudes|se ha producido un error|algo salió mal|inténtelo de nuevo más tarde|en mantenimiento
página não encontrada|a página não existe|erro interno do servidor|acesso negado|serviço indisponível|a sua sessão expirou|sua sessão expirou|inicie sessão novamente|faça login novamente|demasiados pedidos|muitas solicitações|ocorreu um erro|algo deu errado|tente novamente mais tarde|em manutenção
pagina non trovata|la pagina non esiste|errore interno del server|accesso negato|servizio non disponibile|la sessione è scaduta|sessione scaduta|effettua di nuovo l'accesso|troppe richieste|si è verificato un errore|qualcosa è andato storto|riprova più tardi|in manutenzione
pagina niet gevonden|de pagina bestaat niet|interne serverfout|toegang geweigerd|service niet beschikbaar|dienst niet beschikbaar|uw sessie is verlopen|je sessie is verlopen|meld u opnieuw aan|log opnieuw in|te veel verzoeken|er is een fout opgetreden|er ging iets mis|probeer het later opnieuw|in onderhoud
"""
#: Notices that scripts or cookies are required.
SCRIPTS = """
enable javascript|you need to enable javascript to run this app|javascript is disabled|javascript is required to|turn on javascript|javascript must be enabled|please enable|requires javascript|to run this app|to continue
requires scripting|scripting to be on|scripting must be on|turn on scripting|enable scripting|turn on scripts|allow scripts|enable scripts|scripts and cookies switched on|works only with scripts|enable cookies|cookies are disabled|cookies must be enabled|this page works only with|for this page|in your browser to view|to view this job|to view this page|to see this job|your browser does not support|your browser is not supported|browser cannot display this content|noscript|if nothing happens|loading...|loading…
javascript ist deaktiviert|javascript im browser erlauben|javascript erlauben|erlauben sie javascript|skripte erlauben|skripte aktivieren|aktivieren sie javascript|javascript aktivieren|javascript einschalten|bitte aktivieren sie|um die stelle zu sehen|um diese seite zu sehen|cookies aktivieren|ihr browser unterstützt
activer javascript|activez javascript|javascript est désactivé|veuillez activer|pour afficher cette offre|pour afficher cette page|autorisez les cookies|votre navigateur ne
habilite javascript|active javascript|activar javascript|habilitar javascript|javascript está desactivado|para ver esta oferta|para ver esta página|su navegador no|en su navegador para continuar
habilite o javascript|ative o javascript|ativar o javascript|javascript está desativado|no seu navegador para continuar|para ver esta vaga|o seu navegador não
abilita javascript|abilitare javascript|attiva javascript|attivare javascript|javascript è disattivato|per vedere questa offerta|per visualizzare questa pagina|il tuo browser non|nel browser per continuare
schakel javascript in|javascript inschakelen|javascript is uitgeschakeld|zet javascript aan|om deze vacature te bekijken|om deze pagina te bekijken|uw browser ondersteunt|in uw browser om verder te gaan
"""
#: Filler and notes to the writer.
FILLER = """
lorem ipsum|ipsum dolor|sample text|dummy text|placeholder text|filler text|text goes here|your text here|description goes here|add text here|add description here|enter description here|insert text here|insert title here|title goes here|job title here|insert paragraph|about the team here
this is a test posting|this is a test|test posting|please ignore|test test|test job|do not apply|do not publish|replace this sentence|before publishing|replace this text|replace me|to be supplied|description to be supplied by|to be added|to be completed|to be defined|description to follow|text to follow|coming soon|content to come|tbd|tba|tbc|to be confirmed|to be announced|todo|fixme|xxx|add responsibilities|add requirements|add benefits|blah|blah blah|blah description blah|qwerty|asdf|asdfgh|foo bar|foobar|untitled|no title
beispieltext|blindtext|platzhaltertext|text folgt|beschreibung folgt|hier text einfügen|titel einfügen|bitte ignorieren|dies ist ein test|texte d'exemple|texte de remplissage|texte à venir|description à venir|insérer le texte ici|ceci est un test|veuillez ignorer
texto de ejemplo|texto de relleno|descripción pendiente|insertar texto aquí|esto es una prueba|por favor ignorar|texto de exemplo|descrição a definir|inserir texto aqui|isto é um teste|por favor ignore|testo di esempio|testo segnaposto|descrizione in arrivo|inserire testo qui|questo è un test|si prega di ignorare|voorbeeldtekst|opvultekst|tekst volgt|beschrijving volgt|voeg hier tekst in|dit is een test|gelieve te negeren
"""
#: From these, by language, phrases are made: things of the web, what an error page says of them (with a thing before it, or alone),
#: scripts and what has to be done with them, orders to the writer and what is to be written, notes that a text isn't to go out.
WEB = {
    "en": {
        "things": "page|this page|site|website|resource|requested resource|document|content|service|server|url|link|job|job posting|posting|vacancy|position|listing|request|your request|session|your session|connection",
        "states": "is not available|isn't available|is unavailable|is no longer available|is no longer open|no longer exists|has expired|has been removed|cannot be displayed|can't be displayed|could not be displayed|could not be processed|cannot be processed|could not be loaded|timed out|timeout|is temporarily unavailable|cannot be reached|you requested|you are looking for|is loading",
        "alone": "could not be found|cannot be found|can't be found|was not found|does not exist|internal error|an error has occurred|error has occurred while processing|unable to complete your request|connection timed out|attention required|verify you are a human|please wait while|loading please wait|loading, please wait|reload the page|refresh the page|sign in again|log in again|please try again|sorry for the inconvenience|due to inactivity",
        "scripts": "javascript|scripts|scripting|cookies|cookies and javascript|javascript and cookies", "wanted": "is not enabled|isn't enabled|is disabled|are disabled|is turned off|are turned off|turned off|must be enabled|needs to be enabled|to be enabled|enabled to view|enabled to continue|to continue|to view this page|in your browser|and reload",
        "order": "enable|turn on|activate|switch on|allow|you must have|you need|we need|this site requires|this page requires|this application requires|this app requires|your browser has",
        "write": "insert|add|enter|type|paste|write|put", "what": "text|description|job description|title|job title|content|copy|name|company name|details|summary|responsibilities|requirements|benefits", "where": "here",
        "notes": "do not publish|not for publication|for layout purposes|this is placeholder|description coming soon|text coming soon|details to follow|copy to follow|to be written",
    },
    "de": {
        "things": "seite|die seite|webseite|website|dienst|der dienst|server|der server|stelle|die stelle|stellenanzeige|inhalt|sitzung|anfrage|verbindung", "states": "ist nicht verfügbar|nicht verfügbar|ist nicht mehr verfügbar|ist vorübergehend nicht erreichbar|nicht erreichbar|ist abgelaufen|konnte nicht geladen werden|existiert nicht|existiert nicht mehr",
        "alone": "wurde nicht gefunden|konnte nicht gefunden werden|nicht gefunden|angeforderte seite|gesuchte seite|es ist ein fehler aufgetreten|es ist ein unerwarteter fehler aufgetreten|unerwarteter fehler|bitte versuchen sie es erneut|bitte laden sie die seite neu|bitte warten",
        "scripts": "javascript|skripte|cookies", "wanted": "muss aktiviert sein|müssen aktiviert sein|ist nicht aktiviert|ist deaktiviert|aktiviert sein|um fortzufahren|in ihrem browser", "order": "aktivieren sie|diese seite benötigt|diese seite erfordert|für diese seite muss|bitte aktivieren sie|erlauben sie",
        "write": "", "what": "text hier|beschreibung|text|titel|stellenbeschreibung|name|firmenname|inhalt", "where": "einfügen|einsetzen|eingeben|ergänzen", "notes": "nicht veröffentlichen|bitte nicht beachten|hier kommt der text|bitte ergänzen|noch zu ergänzen|wird ergänzt|platzhalter text",
    },
    "fr": {
        "things": "page|la page|site|le site|service|le service|serveur|offre|l'offre|contenu|session|requête", "states": "n'est pas disponible|n'est plus disponible|est indisponible|temporairement indisponible|a expiré|n'existe pas|n'existe plus|est introuvable|n'a pas pu être chargée|demandée",
        "alone": "est introuvable|n'a pas été trouvée|que vous recherchez|que vous cherchez|page demandée|une erreur inattendue s'est produite|erreur inattendue|veuillez réessayer|veuillez patienter|rechargez la page",
        "scripts": "javascript|les scripts|les cookies", "wanted": "doit être activé|doivent être activés|est requis pour|n'est pas activé|pour continuer|dans votre navigateur", "order": "activez|activer|veuillez activer|ce site nécessite|cette page nécessite|ce site requiert",
        "write": "insérer|ajouter|saisir|texte à", "what": "le texte|la description|le titre|le nom|la description du poste|votre texte|insérer", "where": "ici", "notes": "ne pas publier|à compléter|à remplir|texte à insérer ici|description à venir|texte provisoire",
    },
    "es": {
        "things": "página|la página|sitio|el sitio|servicio|el servicio|servidor|oferta|la oferta|contenido|sesión|su sesión|solicitud", "states": "no está disponible|ya no está disponible|no está disponible temporalmente|no disponible|ha expirado|ha caducado|no existe|ya no existe|solicitada",
        "alone": "no se ha encontrado|no encontrada|no se encontró|que busca|página que busca|ha ocurrido un error inesperado|ha ocurrido un error|se ha producido un error inesperado|inténtelo de nuevo|vuelva a intentarlo|espere por favor|recargue la página",
        "scripts": "javascript|los scripts|las cookies", "wanted": "debe estar activado|debe estar habilitado|no está activado|está desactivado|para continuar|en su navegador", "order": "habilite|active|debe habilitar|es necesario activar|es necesario habilitar|este sitio requiere|esta página requiere",
        "write": "insertar|añadir|agregar|escribir|introducir", "what": "texto|descripción|el texto|la descripción|título|nombre", "where": "aquí", "notes": "no publicar|por completar|pendiente de completar|texto aquí|texto provisional",
    },
    "pt": {
        "things": "página|a página|site|o site|serviço|o serviço|servidor|vaga|a vaga|conteúdo|sessão|a sua sessão|pedido", "states": "não está disponível|já não está disponível|não está mais disponível|temporariamente indisponível|está indisponível|expirou|expirada|não existe|já não existe|solicitada",
        "alone": "não foi encontrada|não encontrada|que procura|página que procura|ocorreu um erro inesperado|erro inesperado|tente novamente|aguarde por favor|recarregue a página",
        "scripts": "javascript|o javascript|os scripts|os cookies", "wanted": "deve estar ativado|tem de estar ativado|não está ativado|está desativado|para continuar|no seu navegador", "order": "ative|habilite|é necessário ativar|é necessário habilitar|este site requer|esta página requer",
        "write": "inserir|adicionar|escrever|introduzir", "what": "texto|descrição|o texto|a descrição|título|nome", "where": "aqui", "notes": "não publicar|a completar|por preencher|texto aqui|texto provisório",
    },
    "it": {
        "things": "pagina|la pagina|sito|il sito|servizio|il servizio|server|offerta|l'offerta|contenuto|sessione|la tua sessione|richiesta", "states": "non è disponibile|non è più disponibile|temporaneamente non disponibile|non disponibile|è scaduta|non esiste|non esiste più|richiesta non esiste",
        "alone": "non è stata trovata|non trovata|che cerchi|pagina che cerchi|pagina richiesta|si è verificato un errore imprevisto|errore imprevisto|riprova più tardi|attendere prego|ricarica la pagina",
        "scripts": "javascript|gli script|i cookie", "wanted": "deve essere abilitato|deve essere attivato|non è abilitato|è disattivato|per continuare|nel tuo browser", "order": "abilita|attiva|è necessario abilitare|è necessario attivare|questo sito richiede|questa pagina richiede",
        "write": "inserire|aggiungere|scrivere", "what": "testo|descrizione|il testo|la descrizione|titolo|nome", "where": "qui", "notes": "non pubblicare|da completare|da compilare|testo qui|testo provvisorio",
    },
    "nl": {
        "things": "pagina|de pagina|site|website|dienst|de dienst|server|vacature|de vacature|inhoud|sessie|uw sessie|aanvraag", "states": "is niet beschikbaar|is niet meer beschikbaar|tijdelijk niet beschikbaar|niet beschikbaar|is verlopen|bestaat niet|bestaat niet meer",
        "alone": "is niet gevonden|niet gevonden|kon niet worden gevonden|opgevraagde pagina|die u zoekt|er is een onverwachte fout opgetreden|onverwachte fout|probeer het opnieuw|even geduld|laad de pagina opnieuw",
        "scripts": "javascript|scripts|cookies", "wanted": "moet zijn ingeschakeld|moeten zijn ingeschakeld|is niet ingeschakeld|is uitgeschakeld|in om verder te gaan|om verder te gaan|in uw browser", "order": "schakel|deze site vereist|deze pagina vereist|zet",
        "write": "voeg hier|tekst|", "what": "een beschrijving|tekst|de tekst|een titel|beschrijving", "where": "toe|in|hier|invoegen", "notes": "niet publiceren|nog in te vullen|nog aan te vullen|tekst hier|voorlopige tekst",
    },
}
#: Words for errors and the codes that servers give.
ERROR_WORDS, ERROR_CODES = "error|http error|http status|status|fehler|erreur|error http|erro|errore|fout", "400 401 403 404 405 408 410 429 500 501 502 503 504"
#: Words that stand between what a notice says, whatever it is about; they don't count for a segment that holds a phrase.
GLUE = """
the a an this that you your we our us it is are was be to of in on at and or for by with while please sorry oops
der die das den dem ein eine sie ihr ihre ihren wir uns es ist sind und oder zu für in auf bitte diese dieser um
le la les l un une ce cette vous votre nous il est et ou de du des pour dans sur veuillez désolé
el los las un una este esta usted su nos es y o de del para en por favor lo sentimos
o a os as um uma este esta sua seu nos é e ou de do da para em por favor
il lo gli un una questo questa tuo tua ci è e o di del per in si prega spiacenti
de het een deze dit u uw wij ons is en of van voor in op gelieve helaas
"""
#: Words of the customary Latin filler and of its generators, told by their company, not one by one.
LATIN = """
lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
pellentesque vestibulum suspendisse potenti facilisi facilisis mauris vitae porta urna tortor sapien libero congue mattis nunc donec praesent vivamus aenean phasellus nullam curabitur maecenas integer quisque etiam fusce morbi proin aliquam cras
ultrices ultricies tristique senectus netus malesuada fames turpis egestas habitant metus justo lacus lectus odio orci ornare pharetra placerat posuere pretium primis pulvinar purus rhoncus risus rutrum sagittis scelerisque sem semper sodales sollicitudin
tellus tempus tincidunt ullamcorper varius vehicula vel venenatis viverra volutpat vulputate interdum hendrerit iaculis imperdiet lacinia laoreet leo ligula lobortis luctus maximus molestie neque nibh nec gravida euismod eget efficitur eleifend elementum erat eros felis fermentum feugiat finibus fringilla diam dictum dignissim dui convallis cursus dapibus condimentum blandit bibendum auctor augue arcu ante accumsan ac at a
"""
#: Words of which the names of template fields are made.
FIELDS = """
name first last full middle company employer organisation organization client team city town location office country region state street department division title job role position posting vacancy reference description body html text content summary
date day start end closing deadline salary pay wage rate min max minimum maximum hours hour shift schedule week manager supervisor recruiter hiring contact person phone telephone tel mobile mail email e-mail address candidate applicant user url link website site number no id amount currency bonus percent percentage benefits benefit requirements requirement responsibilities responsibility skills skill level grade type contract duration value here the a of your recipient sender signature greeting subject industry sector brand product project budget age experience education degree language languages zip postcode postal code
nombre apellido empresa ciudad puesto fecha salario correo departamento nom prénom entreprise ville poste date salaire service vorname nachname firma unternehmen stadt ort stelle datum gehalt abteilung firmen stellen ansprechpartner adresse telefon straße anrede nome cognome azienda città posizione data stipendio reparto sobrenome cidade cargo naam bedrijf stad plaats functie salaris afdeling
"""
#: Share of a segment that phrases must cover, and of its words that Latin-like filler must be, of which the least number.
COVER, LEAST_LATIN = 0.5, 4
#: Letters that a word of Latin-like filler that isn't listed may end with, and the share of a segment's words that must be listed then.
LATIN_ENDS, LISTED = ("us", "um", "is", "it", "at", "et", "ae", "am", "em", "or", "ur", "nt", "os", "as", "an", "ibi"), 0.3
_SEGMENT = re.compile(r"(?<=[.!?…;])\s+|\n+|\s+[-–—|•·]+\s+|\s*\|\s*")
_ALNUM = re.compile(r"[^\W_]")
#: Pairs of marks that only templates have, and what may stand between them: anything, or a name.
PAIRS = (
    ("{{", "}}", None), ("{%", "%}", None), ("<%", "%>", None), ("&lt;%", "%&gt;", None), ("${", "}", None), ("#{", "}", None), ("{#", "}", None),
    ("[[", "]]", "name"), ("<<", ">>", "name"), ("&lt;&lt;", "&gt;&gt;", "name"), ("|*", "*|", "name"), ("*|", "|*", "name"), ("@@", "@@", "name"), ("%%", "%%", "name"), ("$$", "$$", "word"), ("%(", ")s", "word"), ("%(", ")d", "word"),
)
_INSIDE = {"name": re.compile(r"\s*[^\W\d_][\w.\- ]*"), "word": re.compile(r"[^\W\d]\w*")}
#: Shapes that only templates have.
_SURE = re.compile(
    r"\{\d+\}|(?<!\w)_{2,}[A-Za-z](?:[\w.\- ]*?[A-Za-z\d])?_{2,}(?!\w)|(?<![\w%])%[A-Za-z][A-Za-z_.]{2,}%(?![\w%])|(?<![\w#])#[A-Z][A-Z0-9_]{2,}#(?![\w#])|\b(?P<edge>[A-Z])(?P=edge)_[A-Z]+(?:_[A-Z]+)*_(?P=edge){2}\b"
    r"|\[object Object\]|\bNaN\b|\b(?:undefined|null)\b(?:\W{1,3}(?:undefined|null)\b)+"
)
#: Brackets that hold a field's name in templates and other things elsewhere.
_MAYBE = re.compile(r"\[([^\[\]\n]{2,})\]|<([^<>\n]{2,})>|&lt;([^&\n]{2,})&gt;|«\s?([^«»\n]{2,}?)\s?»|\{([^{}\n]{2,})\}|\(((?:please )?(?:insert|enter|add|fill in) [^()\n]+)\)", re.I)
#: Marks that the automaton looks for; where one stands, template fields are looked for.
OPENERS = ("{", "[", "<", "&lt;", "«", "%", "$$", "@@", "|*", "*|", "__", "#", "xx_", "yy_", "zz_", "(insert", "(enter", "(add", "(fill", "(please", "nan", "null", "undefined")
_ORDER = re.compile(r"^(?:please )?(?:insert|add|enter|fill in|your|type|replace|choose|select)\b|^(?:einfügen|insérer|insertar|inserir|inserire|invoegen)\b|\b(?:here|einfügen|ici|aquí|aqui|qui|invullen)$", re.I)
_WORDS = re.compile(r"[^\W_]+")
#: Marks with which a writer leaves a note instead of a text.
_LEAD = re.compile(r"[\W_]*(?:todo|fixme|tbd|tbc)\s*:")
_BLANKS = re.compile(r"[^\S\n]+")
_PARTS = re.compile(r"[\W_]+|(?<=[a-z])(?=[A-Z])")


@cache
def _fields() -> frozenset[str]:
    return frozenset(FIELDS.split())


def field_name(inner: str) -> bool:
    """Whether what stands in brackets names a template field: snake, camel or dotted case, an order to the writer, or words that field names are made of."""
    inner = inner.strip()
    if _ORDER.search(inner) or re.fullmatch(r"[A-Za-z]+(?:[_.][A-Za-z0-9]+)+", inner):
        return True
    parts = [p.lower() for p in _PARTS.split(inner) if p]
    return bool(parts) and all(p in _fields() or p.isdigit() or _compound(p) for p in parts)


def _compound(word: str) -> bool:
    """Whether the word is two field words in one, as German makes them."""
    return any(word[:i] in _fields() and word[i:] in _fields() for i in range(3, len(word) - 2))


def _between(text: str, opener: str, closer: str, inside: re.Pattern | None) -> Iterator[tuple[int, int]]:
    """Spans from an opening mark to the next closing one on its line, however long; each character is looked at a bounded number of times."""
    at = text.find(opener)
    while at >= 0:
        start = at + len(opener)
        close = text.find(closer, start)
        if close < 0:
            return
        line = text.find("\n", start, close)
        if line >= 0:
            at = text.find(opener, line)
            continue
        if close > start and (inside is None or inside.fullmatch(text, start, close)):
            yield at, close + len(closer)
            start = close + len(closer)
        at = text.find(opener, start)


def placeholders(text: str) -> list[tuple[int, int]]:
    """Spans of unfilled template fields in the text as it is."""
    spans = [s for opener, closer, inside in PAIRS if opener in text for s in _between(text, opener, closer, _INSIDE.get(inside))]
    spans += [m.span() for m in _SURE.finditer(text)]
    spans += [m.span() for m in _MAYBE.finditer(text) if field_name(next(g for g in m.groups() if g))]
    return spans


def _made_phrases() -> Iterator[tuple[str, str]]:
    """``(kind, phrase)`` that the lists by language make."""
    for own in WEB.values():
        part = {k: v.split("|") for k, v in own.items()}
        yield from (("error", f"{t} {x}") for t in part["things"] for x in part["states"])
        yield from (("error", x) for x in part["alone"])
        yield from (("script", f"{t} {x}") for t in part["scripts"] for x in part["wanted"])
        yield from (("script", f"{o} {t}") for o in part["order"] for t in part["scripts"])
        yield from (("filler", " ".join(x for x in (a, b, c) if x)) for a in part["write"] for b in part["what"] for c in part["where"])
        yield from (("filler", x) for x in part["notes"])
    for word in ERROR_WORDS.split("|"):
        for code in ERROR_CODES.split():
            yield from (("error", f"{word} {code}"), ("error", f"{code} {word}"))
    yield from (("filler", "x" * n) for n in range(4, 13))


@cache
def _glue() -> frozenset[str]:
    return frozenset(GLUE.split())


@cache
def automaton():
    """The automaton of all phrases and filler words; values: (kind, length)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("error", ERRORS), ("script", SCRIPTS), ("filler", FILLER)):
        for phrase in phrases.replace("\n", "|").split("|"):
            if phrase:
                found.add_word(phrase, (kind, len(phrase)))
    for mark in OPENERS:
        if mark not in found:
            found.add_word(mark, ("open", len(mark)))
    found.add_word("ipsum", ("latin", 5))
    for kind, phrase in _made_phrases():
        if phrase not in found:
            found.add_word(phrase, (kind, len(phrase)))
    for word in LATIN.split():
        if len(word) > 4:
            found.add_word(word, ("latin", len(word)))
    found.make_automaton()
    return found


@cache
def _latin() -> frozenset[str]:
    return frozenset(LATIN.split())


def _filler_latin(segment: str) -> bool:
    """Whether enough of the segment's words are words of Latin-like filler, or end like them beside some that are."""
    words = [w for w in re.split(r"[\W\d_]+", segment) if w]
    listed = sum(w in _latin() for w in words)
    like = sum(w in _latin() or w.endswith(LATIN_ENDS) for w in words)
    return len(words) >= LEAST_LATIN and (listed >= max(LEAST_LATIN, COVER * len(words)) or (listed >= max(2, LISTED * len(words)) and like >= 0.9 * len(words)))


def _matches(text: str) -> tuple[list[tuple[int, int, str]], bool, bool]:
    """``(start, end, kind)`` of the automaton's phrases that are whole words, in the order of their ends; whether Latin-like words and opening marks are there."""
    out, n, latin, opened = [], len(text), False, False
    for end, (kind, length) in automaton().iter(text):
        if kind == "open":
            opened = True
            continue
        start, end = end + 1 - length, end + 1
        if (start == 0 or not (text[start - 1].isalnum() and text[start].isalnum())) and (end == n or not (text[end].isalnum() and text[end - 1].isalnum())):
            if kind == "latin":
                latin = True
            else:
                out.append((start, end, kind))
    return out, latin, opened


def _weight(text: str) -> int:
    return len(_ALNUM.findall(text))


def _unmarked_end(plain: str, folded: str, start: int, own: list[tuple[int, int, str]]) -> int:
    """Where a notice that opens a segment ends without a stop: after phrases with nothing else before them, of which the last is of several words in small letters and is followed by a capital; 0 if nowhere."""
    reached, found = start, 0
    for s, e, _ in own:
        if s > reached and _open_weight([folded[reached:s]]):
            break
        reached = max(reached, e)
        last = folded.rfind(" ", s, e) + 1
        if last > s and plain[last].islower() and plain[e : e + 1] == " " and plain[e + 1 : e + 2].isupper():
            found = e
    return found


def _open_weight(parts: list[str]) -> int:
    """Letters and digits of what phrases leave of a segment, without words that any notice has between them."""
    return sum(_weight(w) for part in parts for w in _WORDS.findall(part) if w not in _glue())


def find_residue(text: str) -> tuple[float, float, list[str]]:
    """Share of the text's letters and digits in residue, the greatest share in any one segment, and the kinds found, sorted.

    Kinds: ``template``, ``error``, ``script``, ``filler``. Segments are sentences, lines and what dashes
    and bars part; a segment is residue if phrases cover at least ``COVER`` of its letters and
    digits, words that any notice has between its phrases (``GLUE``) aside, if it begins as a note to
    the writer, or if it is Latin-like filler. A template field is a segment of its own. A text without
    letters and digits has coverage 0. Runs of blanks count as one. Matches and segments are gone
    through side by side, once.
    """
    plain = _BLANKS.sub(" ", text.replace("’", "'").replace("İ", "I"))
    folded = plain.lower()
    found, latin, opened = _matches(folded)
    kinds: set[str] = set()
    covered, dense = 0, 0.0
    fields = placeholders(text) if opened else []
    if fields:
        kinds.add("template")
        dense = 1.0
        covered += sum(_weight(text[a:b]) for a, b in fields)
    if found or latin:
        found.sort()
        start = at = 0
        for end, following in [*(m.span() for m in _SEGMENT.finditer(folded)), (len(folded), len(folded))]:
            first = at
            while at < len(found) and found[at][0] < end:
                at += 1
            own = found[first:at]
            cut = _unmarked_end(plain, folded, start, own) if own else 0
            for a, b in ((start, cut), (cut, end)) if start < cut < end else ((start, end),):
                if not own and not latin:
                    continue
                segment = folded[a:b]
                reached, by, open_parts = a, {}, []
                for s, e, k in own:
                    if a <= s and reached < e <= b:
                        open_parts.append(folded[reached : max(s, reached)])
                        by[k] = by.get(k, 0) + _weight(folded[max(s, reached) : e])
                        reached = e
                weight = sum(by.values())
                size = weight + _open_weight([*open_parts, folded[reached:b]]) if by else 0
                if weight and (weight >= COVER * size or _LEAD.match(segment)):
                    kinds.add(max(sorted(by), key=by.get))
                    covered += _weight(segment)
                    dense = max(dense, weight / size if weight >= COVER * size else 1.0)
                elif latin and _filler_latin(segment):
                    kinds.add("filler")
                    covered += _weight(segment)
                    dense = 1.0
            start = following
    total = _weight(text) if kinds else 0
    return (min(covered / total, 1.0) if total else 0.0), dense, sorted(kinds)


def mark_residue(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """``keep`` with, over the texts of ``columns``, the greatest ``coverage`` and ``dense`` (see ``find_residue``) and all ``kinds``, sorted, joined by commas.

    A row holds residue if ``dense`` is at least ``COVER``, alone or amid other text; by ``coverage``
    callers exclude rows that hold little else. Null and blank texts hold none: 0.0, 0.0 and ''. Repeated rows are each
    marked; very long texts are read whole; an empty table gives none. Columns not named are not
    read. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, float, list[str]]] = {}
        for batch in batches:
            shares, dense, kinds = [], [], []
            for texts in zip(*(batch.column(f"_text{i}").to_pylist() for i in range(len(columns))), strict=True):
                found = []
                for t in texts:
                    if not t:
                        continue
                    one = known.get(t)
                    if one is None:
                        one = find_residue(t)
                        if len(t) < 200:
                            if len(known) > 50_000:
                                known.clear()
                            known[t] = one
                    found.append(one)
                shares.append(max((x[0] for x in found), default=0.0))
                dense.append(max((x[1] for x in found), default=0.0))
                kinds.append(",".join(sorted({k for x in found for k in x[2]})))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shares, pa.float64()), pa.array(dense, pa.float64()), pa.array(kinds, pa.string())], names=[*keep, "coverage", "dense", "kinds"])

    source = df.select(*keep, *[df[c].cast("string").alias(f"_text{i}") for i, c in enumerate(columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)])
    return source.mapInArrow(run, f"{schema}, coverage double, dense double, kinds string")
