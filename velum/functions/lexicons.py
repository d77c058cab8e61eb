"""Types, word lists, thresholds and prefixes that results depend on."""

from __future__ import annotations

ENTITY_TYPES = ("PERSONA", "CODICE_FISCALE", "PARTITA_IVA", "IBAN", "EMAIL", "TELEFONO", "ORGANIZZAZIONE", "LUOGO", "DATA_NASCITA", "INDIRIZZO", "NUMERO_DOCUMENTO")
NAME_TYPES = ("PERSONA", "ORGANIZZAZIONE", "LUOGO")
CODE_PREFIX = {"CODICE_FISCALE": "CF", "PARTITA_IVA": "PIVA", "IBAN": "IBAN", "EMAIL": "EMAIL", "TELEFONO": "TEL", "DATA_NASCITA": "NASC", "INDIRIZZO": "IND", "NUMERO_DOCUMENTO": "DOC"}
FALLBACK_PREFIX = {"PERSONA": "SOGGETTO", "ORGANIZZAZIONE": "ENTE", "LUOGO": "LUOGO"}
LABEL_TYPE = {"PER": "PERSONA", "LOC": "LUOGO", "ORG": "ORGANIZZAZIONE"}
SCORE_THRESHOLD = {"PER": 0.50, "ORG": 0.60, "LOC": 0.65}
DEFAULT_THRESHOLD = 0.50
FORMATS = {"pdf": "pdf", "docx": "docx", "odt": "odt", "md": "markdown", "png": "image", "jpg": "image", "jpeg": "image", "txt": "txt"}
ALLOWED_SUFFIXES = ("pdf", "docx", "odt", "txt", "md", "png", "jpg", "jpeg")
#: Words that make an all-capitals line no name.
CAPITALS_BLOCKED = "inps inail inpgi inpdap spa srl snc sas sapa onlus ong asl usl ssr ssn pec iban cig cup tribunale corte procura ministero comune regione".split()
#: First words of public bodies, which a model takes for organisations.
PUBLIC_BODIES = "tribunale corte procura pretura questura ministero ministro comune regione provincia prefettura inps inail agenzia guardia polizia carabinieri finanza stato repubblica governo parlamento senato camera".split()
#: Fragments of certificates.
CERTIFICATE_NOISE = "ng ca ra tsa ocsp crl sub root g1 g2 g3 g4".split()
#: Words that tell no names apart.
NAME_STOPWORDS = (
    "dott dott.ssa avv ing prof sig sig.ra on dr presidente consigliere giudice relatore ricorrente appellante resistente convenuto attore equa riparazione sez sezione "
    "di del della dello dei degli da in con per tra il lo la le gli un una e o -"
).split()
#: Words with which no name found by a language model begins.
ANSWER_STOPWORDS = (
    "di de del della dello delle degli dei da dal dalla dallo dalle dagli dai in nel nella nello nelle negli nei a al alla allo alle agli ai su sul sulla sullo sulle sugli sui "
    "con per tra fra il lo la le gli i un una uno detto detta detti dette sotto sopra dopo prima come quale quali che chi cui non se più anche già solo sono"
).split()
#: What marks an answer as no name: dates, numbers, legal abbreviations, roles, years ({ws}, {b}: see functions.text).
ANSWER_SPURIOUS = (
    r"\d{2}[\/\-]\d{2}[\/\-]\d{2,4}",
    r"(?iu){b}n\.{ws}*\d+",
    r"(?iu){b}(?:ric\.|sez\.|ud\.|art\.|d\.m\.|d\.lgs\.|legge{ws}\d)",
    r"(?iu)[-–]{ws}*(?:presidente|consigliere|relatore|ricorrente|appellante|resistente|equa{ws}+riparazione)",
    r"{b}(?:20\d{2}|19\d{2}){b}",
)
MODEL_WORDS_MAX = 5
CHUNK_WORDS, CHUNK_BACK = 400, 20
CHUNK_CHARS = 3000
PAGE_LEAST = 50
