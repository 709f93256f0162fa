"""Problem 3: personal information in free text.

Patterns propose spans; checksums and the words around a span move its score;
spans of enough weight are kept. Where spans overlap, the earlier kind of
``KINDS`` keeps its place, then the longer one.

Each form of number that a state issues comes with its check (Luhn, mod 97,
Verhoeff, mod 11, mod 23 or a rule of ranges). A number that passes needs no
other word; one that fails is kept only if a word right before it names what it
is, and never with ``strict``. A bank card needs Luhn, a bank account mod 97,
whatever stands around them.

Texts are read through a view in which invisible characters are left out, odd
spaces are plain ones and digits of any script are ASCII; found values are
given exactly as they stand in the text.

Defined results: null, empty and blank texts have nothing; each distinct value
of a document is one row; ``redact`` leaves all other characters as they are.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.texts import map_texts

KINDS = ("email", "account", "card", "id_number", "phone", "address", "name")
#: The kinds that ``find_personal`` gives unless told otherwise.
FOUND_KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

# ---------------------------------------------------------------- the view of a text

_HIDDEN = frozenset([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_SPACES = (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)
#: Decimal digits of the scripts of South Asia, full-width digits and spaces; each becomes one character.
_PLAIN = {s: " " for s in _SPACES} | {chr_: str(unicodedata.digit(chr(chr_))) for first in (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xFF10) for chr_ in range(first, first + 10)}
_PLAIN |= {0x2010: "-", 0x2011: "-", 0xFF20: "@", 0x2013: "-"}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted({*_HIDDEN, *_PLAIN})) + "]")
_HIDE = re.compile("[" + "".join(chr(c) for c in sorted(_HIDDEN)) + "]")


def view(text: str) -> tuple[str, list[int] | None]:
    """The text as it is read, and the place of each of its characters (and of the end) in ``text``; None if they are the same."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    if not _HIDE.search(text):
        return text.translate(_PLAIN), None
    kept = [k for k, c in enumerate(text) if ord(c) not in _HIDDEN]
    return "".join([text[k] for k in kept]).translate(_PLAIN), [*kept, len(text)]


# ---------------------------------------------------------------- checksums


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(value: str) -> bool:
    turned = "".join(str(int(c, 36)) for c in value[4:] + value[:4])
    return int(turned) % 97 == 1


def mod11_10(digits: str) -> bool:
    product = 10
    for d in digits[:-1]:
        total = (int(d) + product) % 10 or 10
        product = total * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def verhoeff(digits: str) -> bool:
    """The dihedral check of twelve-digit numbers; its tables follow from the group of order ten."""
    check = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        for _ in range(k % 8):
            n = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[n]
        a, b = check, n
        check = (a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5
    return check == 0


def mod23(value: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(value[:-1]) % 23] == value[-1]


def key97(digits: str) -> bool:
    """A number whose last two digits are 97 less the rest of dividing the others by 97."""
    return 97 - int(digits[:-2]) % 97 == int(digits[-2:])


def mod11_twice(digits: str) -> bool:
    """Two check digits, each from the digits before it with weights that fall to 2."""
    for n in (len(digits) - 2, len(digits) - 1):
        rest = sum(int(d) * (n + 1 - k) for k, d in enumerate(digits[:n])) * 10 % 11 % 10
        if rest != int(digits[n]):
            return False
    return True


def is_date(yymmdd: str) -> bool:
    return 1 <= int(yymmdd[2:4]) <= 12 and 1 <= int(yymmdd[4:6]) <= 31


# ---------------------------------------------------------------- e-mail

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]*[A-Za-z0-9_%+-])?"
_EMAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}@(?:{_LABEL}\.)+[A-Za-z]{{2,}}(?![\w-])")
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}]\s?|\s(?:dot|DOT|Dot)\s)"
_AT_MARKED = r"\s?[\[({]\s?(?:at|AT|At|@)\s?[\])}]\s?"
_SPELLED = re.compile(rf"(?<![\w.+%-]){_LOCAL}(?:{_AT_MARKED}(?:{_LABEL}{_DOT})+[A-Za-z]{{2,}}|\s(?:AT|at|At)\s(?:{_LABEL}{_DOT})*{_LABEL}\s(?:DOT|dot|Dot)\s[A-Za-z]{{2,}})(?![\w-])")
_AT_SIGNS = ("at", "AT", "At")
_NO_DOMAIN = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|ico|bmp|css|js|py|txt|md|zip|html?)$", re.I)


def emails(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "@" in text:
        found += [m.span() for m in _EMAIL.finditer(text)]
    if any(f" {w} " in text or f"({w})" in text or f"[{w}]" in text or f"{{{w}}}" in text for w in _AT_SIGNS) or "(@)" in text or "[@]" in text:
        found += [m.span() for m in _SPELLED.finditer(text)]
    return [(a, b, "email") for a, b in found if not _NO_DOMAIN.search(text[a:b])]


# ---------------------------------------------------------------- numbers issued by a state

_ID_CUE = re.compile(
    r"(?:\bS\.?S\.?N\b|social security|\btax[ -]?(?:ID|id|card|payer|number|no)|\bTIN\b|\bnational (?:ID|id|identity|insurance)|\bidentity (?:card|number|no)|\bID (?:card|no|number)|\bpass(?:port|e-?port|aporte)|\breisepass|\bausweis|personalausweis|steuer-?(?:ID|id|nummer|identifikationsnummer)|"
    r"\baadhaar|\baadhar|\bUID(?:AI)?\b|\bPAN\b|\bDNI\b|\bNI[EFNR]\b|\bNINO\b|\bCPF\b|\bCURP\b|\bRFC\b|\bRG\b|\bcarte d.identit|s[ée]curit[ée] sociale|driv(?:ing|er.?s) licen[cs]e|voter id|documento (?:nacional )?de identidad|cart[ãa]o de cidad|"
    r"आधार|पैन|पासपोर्ट|আধার|পাসপোর্ট|ஆதார்|பாஸ்போர்ட்)[^\d\n]{0,22}$",
    re.I,
)
#: What a form of number looks like, how much it says by itself, and its check (None if it has none).
FORMS = (
    (r"\d{3}-\d{2}-\d{4}", 0.4, lambda v, d: d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"),
    (r"[A-Z]{5}\d{4}[A-Z]", 0.4, lambda v, d: v[3] in "ABCFGHJLPT"),
    (r"\d{2} \d{3} \d{3} \d{3}", 0.2, lambda v, d: d[0] != "0" and mod11_10(d)),
    (r"\d{4}[ -]\d{4}[ -]\d{4}", 0.2, lambda v, d: d[0] > "1" and verhoeff(d)),
    (r"\d{8}-?[A-Z]", 0.3, lambda v, d: mod23(v.replace("-", ""))),
    (r"[XYZ]\d{7}[A-Z]", 0.3, lambda v, d: mod23(str("XYZ".index(v[0])) + v[1:])),
    (r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", 0.3, lambda v, d: not set(v[:2]) & set("DFIQUV") and v[1] != "O" and v[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")),
    (r"\d{3}\.\d{3}\.\d{3}-\d{2}", 0.3, lambda v, d: mod11_twice(d)),
    (r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?\d{2} ?\d{3} ?\d{3} ?\d{2}", 0.3, lambda v, d: key97(d)),
    (r"\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}", 0.3, lambda v, d: is_date(d) and (key97(d) or key97("2" + d))),
    (r"\d{3}[ -]\d{3}[ -]\d{3}", 0.0, lambda v, d: d[0] not in "08" and luhn(d)),
    (r"\d{6}[-+]\d{4}", 0.1, lambda v, d: is_date(d) and luhn(d)),
    (r"\d{13}", 0.0, lambda v, d: is_date(d) and d[10] in "01" and luhn(d)),
    (r"[A-Z]{1,2}\d{6,8}[A-Z]?", 0.0, None),
    (r"\d{9,12}", -0.1, None),
)
_ID = re.compile(r"(?=[A-Z]{0,5} ?\d)(?<![\w.+/@=-])(?:" + "|".join(f"({form})" for form, _, _ in FORMS) + r")(?![\w-]|\.\d)")
_ON_FILE = re.compile(r"(?:on file|our records)\W{0,3}$", re.I)
#: What a check that holds, one that fails, a word that names the number and one that tells of records add to the score, and the least score.
HOLDS, FAILS, NAMED, FILED, LEAST = 0.5, -0.2, 0.8, 0.4, 0.6


def id_score(value: str, form: int, before: str, strict: bool = False) -> float:
    digits = "".join(filter(str.isdigit, value))
    score, check = FORMS[form][1], FORMS[form][2]
    if len(set(digits)) == 1:
        return 0.0
    if check is not None:
        holds = check(value, digits)
        if strict and not holds:
            return 0.0
        score += HOLDS if holds else FAILS
    return score + (NAMED if _ID_CUE.search(before) else FILED if _ON_FILE.search(before) else 0.0)


def id_numbers(text: str, strict: bool = False) -> list[tuple[int, int, str]]:
    found = []
    for m in _ID.finditer(text):
        a, b = m.span()
        if id_score(m.group(), m.lastindex - 1, text[max(0, a - 60) : a], strict) >= LEAST:
            found.append((a, b, "id_number"))
    return found


# ---------------------------------------------------------------- bank cards and accounts

_CARD = re.compile(r"(?=[2-6]\d{3})(?<![\w.+/@=-])(?:[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{4}|3[47]\d{2}([ -]?)\d{6}\2\d{5})(?![\w-]|\.\d)")
_ACCOUNT = re.compile(r"(?=[A-Z]{2}\d\d)(?<![\w.+/@=-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")


def bank_numbers(text: str) -> list[tuple[int, int, str]]:
    """Card numbers that Luhn confirms and account numbers that mod 97 confirms; a longer run of groups is tried without its last ones."""
    found = [(*m.span(), "card") for m in _CARD.finditer(text) if len(set(d := "".join(filter(str.isdigit, m.group())))) > 1 and luhn(d)]
    for m in _ACCOUNT.finditer(text):
        a, b = m.span()
        while b - a >= 15:
            plain = text[a:b].replace(" ", "")
            if len(plain) >= 15 and mod97(plain):
                found.append((a, b, "account"))
                break
            b = max(text.rfind(" ", a, b), a)
    return found


# ---------------------------------------------------------------- phone

_PHONE = re.compile(
    r"(?<![\w.,+/@=:-])(?<!\d )(?:"
    r"(?:(?:\+?1|001)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\(?(?:\+\d{1,3}|00\d{1,3})\)?(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,5}\)?){2,6}"
    r"|\(?0\d{1,5}\)?(?:[ ./-]\d{2,8}){1,5}"
    r"|\d{2,5}(?:[ .-]\d{2,5}){1,4}|\d{7,11})(?![\w-]|[.,]\d)"
)
_PHONE_CUE = re.compile(
    r"(?:\btel(?:e(?:ph|f)on[eo]?|éfono|\.)?|\bt[ée]l\.?|\bphone|\bmobile|\bcell|\bfax|\bcall|\bring(?: me| us)?(?: on| at)?|\bnumber is|\breach (?:me|us) (?:on|at)|\bdial|\bWhatsApp|\bllam[ea]n?(?: al)?|\bligue(?: para)?|\btelefone|\bappelez(?:[- ]\w+)?(?: le| au)?|\bunter|\bruf(?:en)? \w+(?: \w+)*|\bfon|\bhandy|"
    r"फ़ोन|फोन|दूरध्वनी|কৃপয়া|ফোন|தொலைபேசி|कृपया|संपर्क)\s?[.:]?\s*[.:]?\s*(?:\w+\s)?$",
    re.I,
)
_NOT_PHONE = re.compile(r"(?:ISBN|ISSN|doi|DOI|order|part|item|lot|invoice|version|release|build|run|grid|number of|years|see \w+,|no\.)\W{0,3}$", re.I)
_YEARS = re.compile(r"\d{4}[-.]\d{2,4}(?:[-.]\d{2})?$")


def phones(text: str, mails: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = []
    for m in _PHONE.finditer(text):
        a, b = m.span()
        value = m.group()
        n = sum(map(str.isdigit, value))
        if not 7 <= n <= 15:
            continue
        if value[0] == "(" and ")" not in value:
            a, value = a + 1, value[1:]
        if value.endswith(")"):
            b, value = b - 1, value[:-1]
        before = text[max(0, a - 30) : a]
        score = 0.0
        if "+" in value[:2] or (value.startswith("00") and n >= 10):
            score += 0.6
        elif re.fullmatch(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", value):
            score += 0.6
        elif re.match(r"\(?0\d", value) and n >= 9 and not value.isdigit():
            score += 0.3
        if _PHONE_CUE.search(before):
            score += 0.6
        if any(0 <= a - e <= 6 and "\n\n" not in text[e:a] for _, e, _ in mails):
            score += 0.5
        if _NOT_PHONE.search(before):
            score -= 0.8
        if _YEARS.fullmatch(value) or ("." in value and value.count(".") == 1 and " " not in value):
            score -= 0.6
        if score >= 0.6:
            found.append((a, b, "phone"))
    return found


# ---------------------------------------------------------------- address

_CAP = r"[A-ZÀ-Þ][\w'’]*(?:-[A-ZÀ-Þ]?[\w'’]+)*"
_TOWN = rf"{_CAP}(?: (?:am|an der|im|bei|sur|sous|en|de|del|de la|do|da|upon|on|la|le) {_CAP})?"
_WAY = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Ct\.?|Close|Terrace|Place|Pl\.?|Way|Square|Sq\.?|Crescent|Row|Hill|Gardens|Park|Mews|Parade|Nagar|Marg|Colony|Chowk|Gali|Path|Sarani)"
_GAP = r"(?:, ?\n? ?|\n[#/* -]*)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|House No\.|House|Plot(?: No\.)?|H\. ?No\.) ?\d+[A-Za-z]?{_GAP})?(?:\d+[A-Za-z]?(?:[-/]\d+[A-Za-z]?)? )?(?:{_CAP} ){{1,3}}{_WAY}{_GAP}{_TOWN}(?:(?:,? ?\n? ?)[A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}|(?:,? ?\n? ?)(?:[A-Z]{{2}} )?\d{{5,6}}(?:-\d{{4}})?)(?!\w)"
    rf"|(?<![\w-])(?:{_CAP}[ -])*{_CAP}(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm)? \d+ ?[a-z]?{_GAP}\d{{5}} {_TOWN}"
    rf"|(?<![\w-])\d+(?: ?(?:bis|ter|[a-d]))?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route|square)(?: (?:de la|de l['’]|des|du|de|d['’]))? ?{_CAP}(?: {_CAP})?{_GAP}\d{{5}} {_TOWN}"
    rf"|(?<![\w-])(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carrera|Rua|Travessa|Praça|Largo|Alameda|Estrada|C/)(?: (?:de la|de los|del|de|das|dos|da|do))? ?{_CAP}(?: {_CAP})?,? (?:n\.?[ºo°] ?)?\d+ ?[A-Za-z]?(?:, ?\d+[ºª°]? ?[A-Z]?)?{_GAP}\d{{4,5}}(?:-\d{{3}})? {_TOWN}"
)
_GERMAN_WAY = re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm) \d", re.I)
_POSTCODE = re.compile(r"\d{5}|[A-Z]\d{1,2} \d[A-Z]{2}")


def addresses(text: str) -> list[tuple[int, int, str]]:
    if not _POSTCODE.search(text):
        return []
    return [(a, b, "address") for m in _ADDRESS.finditer(text) for a, b in [m.span()] if text[a].isdigit() or _GERMAN_WAY.search(text[a:b]) or re.match(r"Flat|Apt|Apartment|Unit|Suite|House|Plot|H\.|Calle|Av|Plaza|Paseo|Camino|Ronda|Carrera|Rua|Travessa|Praça|Largo|Alameda|Estrada|C/", text[a:b])]


# ---------------------------------------------------------------- names

_INITIAL = r"[A-ZÀ-Þ]\."
_WORD_TOKEN = r"[A-ZÀ-Þ][a-zß-ÿ'’]+(?:-[A-ZÀ-Þ][a-zß-ÿ'’]+)*"
_UPPER_TOKEN = r"[A-ZÀ-Þ]{2,}(?:-[A-ZÀ-Þ]{2,})*"
_TOKEN = rf"(?:{_INITIAL}|{_WORD_TOKEN}|{_UPPER_TOKEN})"
_PARTICLE = r"(?:de la|de|del|da|dos|das|van der|van|von|di|bin|al|el|la|le) "
_RUN = re.compile(rf"(?<![\w.@'’-]){_TOKEN}(?: ?[ \n] ?(?:{_PARTICLE})?{_TOKEN})+(?![\w@'’-])")
_PIECE = re.compile(rf"(?:{_PARTICLE})?{_TOKEN}")
_TITLES = frozenset("Dear Mr Mrs Ms Miss Dr Prof Professor Sir Herr Frau Herrn Monsieur Madame Mademoiselle Mme Mlle Señor Señora Sr Sra Don Doña Senhor Senhora Dona Signor Signora Hello Hi Contact Liebe Lieber Cher Chère Querido Querida Estimado Estimada Caro Cara Regards Wishes Sincerely Cheers Grüßen Grüße Atentamente Saludos Cordialement Cumprimentos Atenciosamente".split())
_BEFORE = re.compile(
    r"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sr|Sra|Mme|Mlle|Dra|M)\.?|\b(?:Herrn?|Frau|Monsieur|Madame|Mademoiselle|[Ss]eñor[a]?|[Ss]enhora?|[Dd]oña|[Dd]on|[Dd]ona|श्री|श्रीमती|सुश्री|শ্রী|জনাব|திரு|திருமதி)|"
    r"\bDear|\b(?:[Pp]osted|[Rr]eviewed|[Ww]ritten|[Aa]pproved|[Ss]igned|[Ss]ent|[Pp]repared|[Tt]aken|[Mm]aintained) by|\bAuthor:?|\b[Ii]nterview with|\b[Mm]y name is|\bI am|\b[Jj]e m['’]appelle|\b[Cc]hamo-me|\b[Oo] meu nome é|\b[Mm]e llamo|\b[Mm]i nombre es|\b[Ii]ch hei(?:ß|ss)e|\b[Mm]ein Name ist|मेरा नाम|माझे नाव|আমার নাম|என் பெயர்|"
    r"\b[Ii] asked|\b[Ii]t was|\bcolleague|\b[Cc]ontact:|\b(?:Ansprechpartner|Kontaktperson)(?:in)? ist|\bKontakt:|\bContacto:|\bContato:|\bContact :|"
    r"\b(?:[Rr]egards|[Ss]incerely|[Ww]ishes|[Cc]heers|[Tt]hanks|Grüßen|Grüße|Atentamente|Saludos|Cordialement|cumprimentos|Atenciosamente|भवदीय|आपला|आपली|সাদর|বিনীত|இப்படிக்கு),?|(?:^|[\n>.!?]|\d|\s)[—–] ?)"
    r"[ \n]*(?:(?:#|//|--|\*) )?$"
)
_WEAK = re.compile(r"(?:\bM\.?|\b[Ii]t was|\bI am|\b[Ii] asked|\bcolleague|[—–] ?|\b[Tt]hanks,?)[ \n]*(?:(?:#|//|--|\*) )?$")
#: A dash that begins a line is a signature's.
_DASHED = re.compile(r"(?:^|\n)(?:(?:#|//|--|\*) )?— ?$")
#: What is said of persons: an age, a birth, or a verb of speaking, writing or signing.
_AFTER = re.compile(
    r"^(?:, (?:aged|\d{1,3}|born|âgée?|né|née|geboren|nacid[oa]|nascid[oa]|de \d+ años)\b|, ?\n? ?\d{1,3} years old|"
    r"\s(?:said|says|wrote|writes|told|asked|replied|signed|agreed|was born|has signed|sagte|schrieb|fragte|hat (?:gesagt|geschrieben|unterschrieben)|a (?:dit|écrit|signé|répondu)|dijo|escribió|firmó|preguntó|disse|escreveu|assinou|perguntou|ने)\b)"
)
_WEAK_AFTER = {"It was": re.compile(r"^\s(?:who|that)\b"), "I asked": re.compile(r"^\s(?:about|for|if|whether|to)\b"), "colleague": re.compile(r"^\s*[,.]")}
_NO_NAME = frozenset(
    "The This That These Those A An And But Or If When While Although As At By For From In On Of To With Our My Your His Her Their We They You He She It There Then So No Not Nobody What Who How Why Would Could Should Most More After Before "
    "Der Die Das Den Dem Ein Eine Im Am Nach Vor Seit Wer Was Ob Man Zur Zum Trotzdem Unser Le La Les Un Une Des Du Au Dans Pour Avant Depuis El Los Las Una Por Para Desde Antes O Os As Um Uma No Na Nos Institute University College Street Road Lane Close Avenue River Lake Station "
    "Call Write Reply Replies Please Contact Tel Email Phone Passport Chapter User Thought Action Observation Final Answer Kind Best Order Part Grid Hence Step Let Don Kontakt Interview Posted Reviewed Ring Thanks Dear On Only Plot Flat House Questions".split()
)
_NATIVE = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x900, 0x963), (0x970, 0x9E3), (0xB80, 0xBE3))) + "]+"
_NATIVE_NAME = rf"{_NATIVE} {_NATIVE}"
_NATIVE_CUED = re.compile(
    rf"(?:(?:श्रीमती|सुश्री|श्री|শ্রী|জনাব|திருமதி|திரு) (?P<a>{_NATIVE_NAME})(?= ने\b| यांनी\b|\s|$)|(?:मेरा नाम|माझे नाव|আমার নাম|என் பெயர்) (?P<b>{_NATIVE_NAME})(?= है| आहे|[।.\n]|$)|(?:भवदीय|आपला|आपली|আপনার|বিনীত|இப்படிக்கு),?\s+(?P<c>{_NATIVE_NAME})(?=\s|$))"
)
_NATIVE_END = re.compile(rf"(?:^|[\n>।.!?] ?)(?P<n>{_NATIVE_NAME})(?:,? ?[<(]?|\n(?:(?:#|//|--) )?)$")
_LATIN_END = re.compile(rf"(?<![\w.@-])(?P<n>(?:(?:{_INITIAL} ?)+|(?:{_WORD_TOKEN}|{_UPPER_TOKEN}) (?:{_INITIAL} ?)*)\n?(?:{_WORD_TOKEN}|{_UPPER_TOKEN}))(?:,? ?[<(]?| ?\r?\n(?:(?:#|//|--) )?)$")


def _grammar(text: str, pieces: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The name that begins at the first piece: a given name or initials, initials, a family name."""
    k, given, initials = 0, 0, 0
    while k < len(pieces):
        a, b = pieces[k]
        token = text[a:b]
        if k and text[pieces[k - 1][1] : a].count("\n") > (1 if given + (k > 0) < 2 else 0):
            return None
        if token.endswith("."):
            initials += 1
            k += 1
            continue
        if token.split(" ")[-1].title() in _NO_NAME or token in _TITLES:
            return None
        if given or initials and not given and k == initials:
            return pieces[0][0], b
        given = 1
        k += 1
    return None


def names(text: str, mails: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    found = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        pieces = [(a + p.start(), a + p.end()) for p in _PIECE.finditer(m.group())]
        titles = [k for k, (s, e) in enumerate(pieces[:-1]) if text[s:e].rstrip(".") in _TITLES]
        own = None
        if titles:
            own = _grammar(text, pieces[titles[-1] + 1 :])
            # Another name may stand before the title.
            if titles[0] >= 2 and _BEFORE.search(text[max(0, a - 34) : a]) and (first := _grammar(text, pieces[: titles[0]])):
                found.append((*first, "name"))
        elif pieces[0][1] - pieces[0][0] > 1:
            before = text[max(0, a - 34) : a]
            cue = _BEFORE.search(before)
            if cue:
                own = _grammar(text, pieces)
                if own and (weak := _WEAK.search(before)):
                    after = text[own[1] : own[1] + 14]
                    kind = next((w for w in _WEAK_AFTER if w.lower() in weak.group().lower()), None)
                    if kind and not _WEAK_AFTER[kind].search(after):
                        own = None
                    elif not kind and not _DASHED.search(before) and not re.match(r"\s*(?:\n|<|$|[,.|(])|\s+[A-ZÀ-Þ]|\s+[^\x00-\x7f]", after):
                        own = None
        if own is None and len(pieces) >= 2:
            # A name at the end of the run, by what follows it.
            for n in (3, 2):
                if len(pieces) >= n and _AFTER.search(text[b : b + 30]):
                    if (own := _grammar(text, pieces[-n:])) and own[1] == b:
                        break
                    own = None
        if own:
            found.append((*own, "name"))
    for a, _, _ in mails:
        before = text[max(0, a - 64) : a]
        m = _LATIN_END.search(before)
        if m:
            s = max(0, a - 64) + m.start("n")
            pieces = [(s + p.start(), s + p.end()) for p in _PIECE.finditer(m.group("n"))]
            while len(pieces) > 2 and text[pieces[0][0] : pieces[0][1]].rstrip(".") in _TITLES:
                pieces = pieces[1:]
            own = _grammar(text, pieces)
            if own:
                found.append((*own, "name"))
        elif not before.isascii() and (m := _NATIVE_END.search(before)):
            s = max(0, a - 64)
            found.append((s + m.start("n"), s + m.end("n"), "name"))
    if not text.isascii():
        for m in _NATIVE_CUED.finditer(text):
            g = "a" if m.group("a") else "b" if m.group("b") else "c"
            found.append((*m.span(g), "name"))
    return found


# ---------------------------------------------------------------- the operator


def spans(text: str, strict: bool = False) -> list[tuple[int, int, str]]:
    """Start, end and kind of each piece of personal information in ``text``, in order, none overlapping another."""
    seen, places = view(text)
    mails = emails(seen)
    found = mails + (bank_numbers(seen) + id_numbers(seen, strict) + phones(seen, mails) + addresses(seen) if any(map(seen.__contains__, "0123456789")) else []) + names(seen, mails)
    rank = {k: n for n, k in enumerate(KINDS)}
    kept: list[tuple[int, int, str]] = []
    # An address holds its numbers.
    for s in sorted(found, key=lambda s: (s[2] != "address" and rank[s[2]] > 0, rank[s[2]], s[0] - s[1], s[0])):
        if all(s[1] <= a or b <= s[0] for a, b, _ in kept):
            kept.append(s)
    kept.sort()
    if places is None:
        return kept
    return [(places[a], places[b - 1] + 1, k) for a, b, k in kept]


def redacted(text: str) -> str:
    """``text`` with each span replaced by its kind's placeholder."""
    out, at = [], 0
    for a, b, kind in spans(text):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = FOUND_KINDS, strict: bool = False) -> DataFrame:
    """``id_col``, ``kind``, ``value``: each distinct piece of personal information of each row, of ``kinds``."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])

    def make():
        def act(keys: list, texts: list) -> list:
            rows = [(key, kind, value) for key, t in zip(keys, texts) if t for kind, value in dict.fromkeys((k, t[a:b]) for a, b, k in spans(t, strict) if k in kinds)]
            return [list(x) for x in zip(*rows)] if rows else [[], [], []]

        return act

    return map_texts(df, [id_col, text_col], text_col, out, make)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col`` with typed placeholders; a null text stays null."""
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(text_col, T.StringType())])

    def make():
        return lambda keys, texts: [keys, [redacted(t) if t else t for t in texts]]

    return map_texts(df, [id_col, text_col], text_col, out, make)
