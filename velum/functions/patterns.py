"""Registry of extraction patterns: rows of stage, name, type, expression and capturing groups.

Fixed values: results must equal the origin's, so the grammars are stated as they are, with {ws}, {sp}, {nows} and
{b} for blanks (alone and within a class), other characters and word boundaries (see functions.text).
"""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    stage: int  # 0 sentence headers, 1 structured, 2 lists and signatures, 3 generic
    name: str
    type: str
    regex: str
    groups: int  # 0: the whole match is the value; 1, 2: the first group that took part
    gate: str = ""  # cheap condition that every match implies


_TITLE = r"(?:(?:dott\.?(?:ssa)?|avv\.?|prof\.?|ing\.?){ws}+)?"
_ROLE = r"(?:presidente|consigliere|rel\.?{ws}*consigliere|giudice|sostituto{ws}+procuratore|procuratore|cancelliere|segretario|relatore|estensore|componente)"
_NAME = r"[A-ZÀ-Ü][A-ZÀ-Üa-zà-ü']+(?:{ws}+[A-ZÀ-Ü][A-ZÀ-Üa-zà-ü']+){1,3}"
_NAME_LATIN = r"[A-Z][A-Za-zÀ-ÿ']+(?:{ws}+[A-Z][A-Za-zÀ-ÿ']+){1,3}"
_PARTY = "ricorrente|resistente|appellante|appellato|intimato|controricorrente|opponente|opposto|attore|convenuto|debitore|creditore|fallito|fallendo|istante|intervenuto"
_DATE = r"\d{1,2}[.\/\-]\d{1,2}[.\/\-]\d{2,4}"

PATTERNS = (
    Pattern(0, "header", "PERSONA", r"(?iu)" + _TITLE + r"([A-ZÀ-Ü][A-ZÀ-Üa-zà-ü]*'?[A-ZÀ-Üa-zà-ü]*(?:{ws}+[A-ZÀ-Ü][A-ZÀ-Üa-zà-ü']+){1,3}){ws}*[-–]{ws}*" + _ROLE + r"{ws}*[-–]", 1, r"(?iu)[-–]{ws}*" + _ROLE + r"{ws}*[-–]"),
    Pattern(1, "party", "PERSONA", r"(?iu)(?:^|\n){ws}*(?:" + _PARTY + r")[:,{sp}]+(" + _NAME + ")", 1),
    Pattern(1, "defender", "PERSONA", r"(?iu)(?:difeso|difesa|rappresentato|rappresentata|assistito|assistita){ws}+(?:dall?['’])?(?:avv\.?|avvocato|procuratore){ws}+(" + _NAME_LATIN + ")", 1),
    Pattern(1, "allcaps", "PERSONA", r"(?m)(?:^|\n)([A-ZÀ-Ü][A-ZÀ-Ü']{1,25}(?:{ws}+[A-ZÀ-Ü][A-ZÀ-Ü]{1,25}){1,2})(?:{ws}*$|{ws}*[+]|{ws}*[-–]{ws}*(?:$|\n))", 1),
    Pattern(1, "birthdate", "DATA_NASCITA", r"(?iu)(?:nato|nata|n\.)[,{sp}]+(?:a{ws}+{nows}+{ws}+)?il{ws}+(" + _DATE + r")|(?:data(?:{ws}+di)?{ws}+nascita|d\.d\.n\.)[:{sp}]+(" + _DATE + ")", 2),
    Pattern(1, "address", "INDIRIZZO", r"(?iu)(?:residente|domiciliato|domiciliata|con{ws}+sede){ws}+(?:in{ws}+)?(?:Via|Viale|Corso|Piazza|Largo|Vicolo|Str\.|Loc\.|Fraz\.|V\.le){ws}+[A-Za-zÀ-ÿ{sp}0-9,.']{3,50},?{ws}*\d{5}", 0),
    Pattern(1, "docno", "NUMERO_DOCUMENTO", r"(?iu)(?:carta(?:{ws}+d[i']{ws}*identit[àa])?|passaporto|patente|C\.I\.E?\.?)[:,n.°{sp}]+([A-Z]{2}[0-9]{5,7}[A-Z]?)|(?:n(?:umero)?\.?{ws}*doc(?:umento)?[:{sp}]+)([A-Z]{2}[0-9]{5,7}[A-Z]?)", 2),
    Pattern(1, "policy", "PERSONA", r"(?iu)(?:Contraente|Assicurato|Assicurata|Beneficiario|Intestatario)[:{sp}]+(" + _NAME_LATIN + ")", 1),
    Pattern(1, "contract", "PERSONA", r"(?iu)(?:tra|fra){ws}+(" + _NAME_LATIN + r"),{ws}+(?:nato|nata|residente|domiciliato|codice{ws}+fiscale|con{ws}+sede)", 1),
    Pattern(1, "expert", "PERSONA", r"(?iu)(?:Paziente|CTU|C\.T\.U\.|CTP|C\.T\.P\.|Perito|Esaminato|Esaminata)[:{sp}]+(" + _NAME_LATIN + ")", 1),
    Pattern(2, "lawyers", "PERSONA", r"(?iu)avvocat[oi]{ws}+((?:" + _NAME_LATIN + r")(?:{ws}*,{ws}*(?:" + _NAME_LATIN + "))*)", 1),
    Pattern(2, "signature", "PERSONA", r"(?iu)Firmato{ws}+Da:{ws}+([A-Z][A-ZÀ-Ü]+{ws}+[A-Z][A-ZÀ-Ü]+){ws}+Emesso", 1),
    Pattern(3, "cf", "CODICE_FISCALE", r"(?iu){b}[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]{b}", 0),
    Pattern(3, "piva", "PARTITA_IVA", r"(?iu){b}(?:P\.?{ws}?IVA{ws}*:?{ws}*)?([0-9]{11}){b}", 1),
    Pattern(3, "iban", "IBAN", r"(?iu){b}IT[0-9]{2}[A-Z][0-9]{22}{b}", 0),
    Pattern(3, "email", "EMAIL", r"(?iu){b}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}{b}", 0),
    Pattern(3, "phone", "TELEFONO", r"{b}(?:\+39[{sp}\-]?)?(?:0[0-9]{1,3}[{sp}\-]?[0-9]{5,8}|3[0-9]{2}[{sp}\-]?[0-9]{6,7}){b}", 0),
)
BY_NAME = {p.name: p for p in PATTERNS}
