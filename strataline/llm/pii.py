"""Personal information in free text: names, mail addresses, phone numbers, identity numbers, street addresses.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs in all spellings,
schemes, digits, cues of identity numbers, street words, greetings, titles, and the tokens
of a name lexicon. From each anchor a local parser expands to the occurrence's boundaries
and validates its shape: account and card numbers by their check digits, an address with
the unit, code and town behind it, a phone number with its extension. Identity numbers are
not held to their check digits, as a mistyped one names a person all the same. The lexicon
is learned from the corpus itself: the display names that stand before mail addresses,
kept where their tokens also occur in mailbox names; a short list of given names comes first.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.core.runtime import cut

#: Most tokens of the name lexicon, as it goes to every worker. None is left out: a corpus with more is an error.
LEXICON_TOKENS = 1_000_000
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "account": "[ACCOUNT]"}
#: Kinds that are reported; account and card numbers are only redacted.
REPORTED = ("name", "email", "phone", "id_number", "address")

Span = tuple[int, int, str]

# --- mail addresses -------------------------------------------------------------------

_AT = ("@", "＠", "(at)", "[at]", "{at}", " at ")
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?| dot )"
_DOMAIN = re.compile(rf"\s?[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*?{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9\-@])(?!{_DOT}[A-Za-z0-9])", re.I)


def _mail(text: str, low: str, start: int, end: int, spelled: str, schemes: list[int]) -> Span | None:
    """The mailbox around an at-sign: the longest local part before it and a dotted domain after it."""
    domain = _DOMAIN.match(text, end)
    if not domain:
        return None
    # A spelled-out at needs a spelled-out dot, else it is the ordinary word.
    if spelled == " at " and " dot " not in low[end : domain.end()]:
        return None
    if domain.group()[:1].isspace() and spelled in ("@", "＠") and not text[start - 1 : start].isspace():
        return None  # a misread letter before a space
    left = start - 1 if text[start - 1 : start] == " " else start
    begin = left
    while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+%'-"):
        begin -= 1
    while begin < left and not text[begin].isalnum():
        begin += 1
    if begin >= left or (schemes and schemes[-1] == begin):
        return None  # the user of a link, or nothing
    return begin, domain.end(), "email"


# --- numbers --------------------------------------------------------------------------

_RUN = re.compile(r"\d(?:[  \n.()/\-‐‑–]{0,2}[\dA-Z]){5,}")
_GROUP = re.compile(r"[\dA-Z]+")
_END = r"(?![^\W_]|[-./]\d)"
_SEP = r"[  \-‐‑–]"
# Shapes of identity numbers: British, Spanish foreigner and citizen, German document, American, French, German tax.
_ID_SHAPES = re.compile(
    rf"(?:[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D]|[XYZ]-?\d{{7}}-?[A-Z]|\d{{8}}-?[A-Z]|[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d|\d{{3}}{_SEP}\d\d{_SEP}\d{{4}}"
    rf"|[12] \d\d \d\d \d\d \d{{3}} \d{{3}}(?: \d\d)?|\d\d \d{{3}} \d{{3}} \d{{3}}){_END}"
)
_ID_PLAIN = re.compile(rf"\d{{9,13}}{_END}")
# Words that announce an identity number.
_ID_CUES = (
    "national id", "tax number", "tax id", "social security", "ssn", "passport", "identity", " id ", " id:", " id card", "id no", "id number", "driving licence", "driver's license",
    "dni", "nie ", "nie:", "nif", "documento", "pasaporte", "seguridad social", "steuer-id", "steuerid", "steuernummer", "ausweis", "reisepass", "sozialversicherung",
    "sécurité sociale", "pièce d'identité", "carte d'identité", "passeport", "numéro fiscal", "codice fiscale",
)
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Z\d])")
_CARD = re.compile(r"\d{4}([ \-]?)\d{4,6}\1\d{4,5}(?:\1\d{1,4})?(?![^\W_])")
_EXTENSION = re.compile(r",?\s?[(\[]?(?:ext(?:ension|ensión)?\.?|x|durchwahl|dw\.?|poste|anexo|int\.)\s?:?\s?\d{1,6}[)\]]?(?![^\W_])", re.I)


def _is_iban(found: str) -> bool:
    """Whether the check digits of an account number are right: with the first four characters last and letters as numbers, the rest by 97 is one."""
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _is_card(found: str) -> bool:
    """Whether the check digit of a card number is right: every second digit from the right doubled, the digit sum is divisible by ten."""
    digits = [int(c) for c in found if c.isdigit()]
    return 13 <= len(digits) <= 19 and digits[0] in (3, 4, 5, 6) and sum(digits[::-1][0::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in digits[::-1][1::2]) % 10


_PHONE_SHAPES = re.compile(
    rf"(?:\+\d{{1,3}}(?:[  .\-‐‑–/]?\(?\d{{1,4}}\)?){{2,6}}\d?|\+\d{{8,15}}|00\d{{1,3}}(?:[  .\-‐‑–/]\(?\d{{1,6}}\)?){{2,5}}|\(\d{{2,5}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,5}}"
    rf"|\d{{3}}[.\-‐‑–]\d{{3}}[.\-‐‑–]\d{{4}}|\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}|0\d(?:[  .\-‐‑–]\d\d){{4}}|0\d{{2,4}}/\d{{3,}}(?:[ \-‐‑–]\d+)*"
    rf"|0\d{{2,3}} \d{{3,4}} \d{{4}}|0\d{{4}} \d{{6}}|\d{{3}}[\-‐‑–]\d{{4}}){_END}"
)


def _number(text: str, flat: str, at: int, cues: list[int]) -> Span | None:
    """The identity or phone number that starts at a position; a bare run of digits is only a candidate unless a cue announces it."""
    for source in (text, flat):
        m = _ID_SHAPES.match(source, at)
        if m and text.count("\n", at, m.end()) < 2:  # figures below each other are a column
            return at, m.end(), "id_number"
        m = _ID_PLAIN.match(source, at)
        if m:
            k = bisect_left(cues, at + 1) - 1
            between = flat[cues[k] : at] if k >= 0 and at - cues[k] <= 16 else "0"
            return at, m.end(), "maybe_id" if any(c.isdigit() for c in between) or "\n" in text[at - len(between) : at] else "id_number"
        m = _PHONE_SHAPES.match(source, at)
        if m and 7 <= sum(c.isdigit() for c in m.group()) <= 15 and text.count("\n", at, m.end()) < 2:
            extension = _EXTENSION.match(flat, m.end())
            return at, extension.end() if extension else m.end(), "phone"
    return None


def _account(text: str, at: int) -> Span | None:
    """An account or card number whose first digit is at a position."""
    if at >= 2 and (m := _IBAN.match(text, at - 2)) and not text[max(0, at - 3) : at - 2].isalnum():
        found = m.group()
        while found and not _is_iban(found):  # a word behind it may look like its last group
            found = found.rpartition(" ")[0]
        if found:
            return at - 2, at - 2 + len(found), "account"
    if (m := _CARD.match(text, at)) and _is_card(m.group()):
        return at, m.end(), "account"
    return None


def _numbers(text: str, starts: list[int], cues: list[int]) -> Iterator[Span]:
    """Numbers around the digit runs that start at some positions."""
    flat = None
    done = run_end = -1
    for start in starts:
        if start < done:
            continue
        account = _account(text, start)
        if account:
            yield account
            done = account[1]
            continue
        if start >= run_end:
            run = _RUN.match(text, start)
            if not run:
                continue
            run_end = run.end()
            flat = flat or text.replace("\n", " ")
            groups = [m.start() for m in _GROUP.finditer(text, start, run_end)]
        else:
            groups = [start]
        for at in groups:
            if at < done:
                continue
            before = text[at - 1 : at]
            if before == "(" or before == "+":
                at -= 1
            elif text[at].isdigit():
                # Letters that belong to the number stand directly before it, or before one space.
                for k in (1, 2, 3):
                    head_ = text[at - k : at]
                    if head_ and re.fullmatch(r"[A-Z]{1,2} ?", head_) and not text[max(0, at - k - 1) : at - k].isalnum() and (found := _number(text, flat, at - k, cues)):
                        yield found
                        done = found[1]
                        break
                if done > at:
                    continue
            prior = text[max(0, at - 2) : at]
            if prior[-1:].isalnum() or (prior[-1:] in "-./:" and prior[-1:] and prior[:1].isdigit()):
                continue
            found = _number(text, flat, at, cues)
            if not found and before == "(":
                at += 1
                found = _number(text, flat, at, cues)
            if found:
                yield found
                done = found[1]


# --- street addresses -----------------------------------------------------------------

_CAP = r"(?-i:[^\W\d_a-zß-öø-ÿ])[\w'’\-]*"
# A street named by its place counts only with a code and a town.
_AT_ADDRESS = re.compile(r"(?<!\w)(?:Am|An\sder|Auf\sdem|Auf\sder|Im|In\sder|Zum|Zur)\s(?:(?:Alten|Neuen|Großen|Kleinen|Oberen|Unteren|Hohen)\s)?[A-ZÄÖÜ][a-zäöüß\-]+\s\d{1,4}(?:\s?[a-z]\b)?,?\s+\d{5}\s[A-ZÄÖÜ]")
_STREETS = [
    # House number first: English, then French.
    (("road", "rd", "street", " ave", "lane", "court", "square", "drive", "terrace", "blvd", "boulevard", " st"),
     re.compile(rf"(?<![\w.,\-/])\d{{1,5}}[A-Za-z]?,?\s(?:[NSEW]\.\s)?(?:{_CAP}\s){{1,3}}(?:Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Court|Ct|Square|Sq|Drive|Terrace|Blvd|Boulevard|Way|Crescent)\b", re.I)),
    (("rue", "quai", "avenue", "impasse", " bd ", "\nbd ", "boulevard", "place", "chemin", "allée", "route"),
     re.compile(rf"(?<![\w.,\-/])\d{{1,5}}(?:\s?(?:bis|ter|quater|[A-D]))?,?\s(?:rue|quai|avenue|av\.|impasse|bd|boulevard|place|chemin|allée|route|cours)\s(?:(?:de\s(?:la\s|l['’])?|du\s|des\s|d['’]))?{_CAP}")),
    # Street first: Spanish, then German.
    (("calle", "c/", "avda", "avenida", "paseo", "plaza", "camino", "ronda"),
     re.compile(rf"(?<!\w)(?:Calle|C/|Avda\.|Avenida|Paseo|Plaza|Camino|Ronda)\s(?:(?:de|del|la|las|los|el|y)\s)*{_CAP}(?:\s(?:(?:de|del|la|las|los)\s)*{_CAP}){{0,3}},?\s(?:n\.?\s?[ºo°]\.?\s?)?\d{{1,5}}", re.I)),
    (("gasse", "straße", "strasse", "str.", "weg", "allee", "platz", "ufer", "damm", "steig"),
     re.compile(rf"(?<!\w)(?:(?:(?:Alte[rns]?|Neue[rns]?|Große|Kleine|Obere|Untere|Hintere|Vordere|Lange|Hohe)\s)?(?-i:[A-ZÄÖÜ])[\w\-]*(?:gasse|straße|strasse|str\.|weg|allee|platz|ufer|damm|steig)|(?-i:{_CAP})\s(?:Gasse|Straße|Strasse|Str\.|Weg|Allee|Platz|Ufer|Damm|Steig))\s\d{{1,4}}(?:\s?[a-z]\b)?", re.I)),
    # Italian; boxes.
    (("via ", "viale ", "piazza ", "corso "),
     re.compile(rf"(?<!\w)(?:Via|Viale|Piazza|Corso)\s(?:(?:del|della|dei|delle|di|dell['’])\s?)?{_CAP}(?:\s{_CAP}){{0,2}},?\s\d{{1,4}}(?:/?[a-z]\b)?")),
    (("box ", "postfach "), re.compile(r"(?<!\w)(?:P\.?\s?O\.?\s?Box|Postfach)\s\d{1,6}(?:\s\d{2,3})*", re.I)),
    (("am ", "an der ", "auf dem ", "im ", "zum ", "zur "), _AT_ADDRESS),
]


_UNIT = r"(?:Unit|Apt|Apartment|Suite|Ste|Floor|Fl|Room|Flat|bât|bâtiment|appt|étage|piso|planta|puerta|esc|Whg|Wohnung|Stock|Etage|Top)"
_TOWN = rf"{_CAP}(?:[\s\-](?![A-Z]{{1,2}}\d)(?:(?:am|an der|im|bei|de|del|la|las|los|le|les|sur|sous|upon|on)\s)?{_CAP}){{0,3}}"
# What follows street and number: a direction, units, then a code with a town, or a town with a region and a code.
_BEHIND = re.compile(rf"(?:\s[NSEW][NSEW]?\b)?(?:,?\s{_UNIT}\.?\s?[\w\-]{{1,6}}|,\s(?:bajo|principal|ático|entresuelo|rez-de-chaussée|EG|DG)\b|,\s\d{{1,2}}[ºª°](?:\s?[A-Z])?\b|,?\s?#\s?\d{{1,5}})*")
_CODE_TOWN = re.compile(rf",?\s+(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s{_TOWN}")
_TOWN_CODE = re.compile(rf",\s+({_TOWN})((?:,\s|\s)[A-Z]{{2,3}}\b)?([ \t](?:\d{{4,5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}})(?!\w| \d))?")


def _address(text: str, at: int, shape: re.Pattern) -> Span | None:
    """The address around a street word, from street or house number, whichever comes first, to the last of what follows."""
    for m in shape.finditer(text, max(0, at - 120), min(len(text), at + 160)):
        if m.start() <= at < m.end():
            end = m.end() if m.re is _AT_ADDRESS else _BEHIND.match(text, m.end()).end()
            if m.re is _AT_ADDRESS:
                town = _CODE_TOWN.search(text, m.start())  # the shape ends in the town's first letter
                return m.start(), max(end, town.end() if town else end), "address"
            if town := _CODE_TOWN.match(text, end):
                end = town.end()
            return m.start(), end, "address"
    return None


def _with_town(text: str, span: Span, taken: list[tuple[int, int]]) -> Span:
    """An address with the town behind it; where no code shows that it is one, the words must not be a name's."""
    town = _TOWN_CODE.match(text, span[1])
    if not town:
        return span
    k = bisect_left(taken, (span[1], -1))
    named = k < len(taken) and taken[k][0] < town.end()
    return span if named and not town.group(3) else (span[0], town.end(), span[2])


# --- names ----------------------------------------------------------------------------

_TOKEN = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*"
_PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "ten", "ter", "zu"}
_PARTICLE_RUN = r"(?:(?:van|von|der|den|de|del|della|di|da|du|la|le|ten|ter|zu)\s)+"
# Given names that are ordinary words too: alone they need a context that asks for a person.
_ORDINARY = {"will", "mark", "rose", "grace", "april", "summer", "may", "june", "august", "hope", "faith", "joy", "bill", "frank", "jack", "art", "dawn", "iris", "ivy", "lily",
             "pat", "ray", "rob", "sandy", "sky", "sunny", "victor", "violet", "olive", "pearl", "ruby", "amber", "basil", "chase", "drew", "gene", "grant", "guy", "lance", "max", "miles", "penny"}
_GREETINGS = ("dear ", "hi ", "hello ", "hey ", "hola ", "bonjour ", "hallo ", "guten tag ", "querida ", "querido ", "cher ", "chère ", "liebe ", "lieber ", "salut ", "estimado ", "estimada ")
_TITLES = ("mr ", "mr. ", "mrs ", "mrs. ", "ms ", "ms. ", "dr ", "dr. ", "prof. ", "herr ", "herrn ", "frau ", "mme ", "mlle ", "monsieur ", "madame ", "sr. ", "sra. ", "señor ", "señora ", "don ", "doña ")
_NOT_NAMES = {"all", "team", "everyone", "everybody", "there", "both", "folks", "colleagues", "customer", "support", "sir", "madam", "hr", "ops", "it", "dr", "herr", "herrn", "frau", "mr", "mrs", "ms",
              "mme", "monsieur", "madame", "the", "we", "and", "zusammen", "alle", "todos", "tous", "kollegen", "kolleginnen", "damen", "prof", "sr", "sra", "payroll", "admin"}
_PERSON_BEFORE = re.compile(
    r"(?:\w=|(?:^|[\s>(=:'’])(?:dear|hi|hello|hey|hola|bonjour|hallo|herrn?|frau|mme|ms\.?|mrs\.?|mr\.?|dr\.?|sra?\.|call|ask|tell|meet|thank|invite|appeler|bitte|by|for|of|to|from|from:|and|an|with|as|is|à|a|y|et|und|zu|de|al|con|por|par|avec|mit|von|für|=)\s?)$",
    re.I,
)
_PERSON_AFTER = re.compile(r"\s(?:said|says|wrote|asked|called|moved|lives|works|wohnt|schreibt|sagt|arbeitet|vive|trabaja|dice|habite|travaille|dit)\b|\s?[<|(]|\s-\s")
_INITIAL_BEFORE = re.compile(r"(?<![^\W_])[^\W\d_]\.\s?(?:[^\W\d_]\.\s?)?$")
_FREE_NAME = re.compile(rf"{_CAP}(?:\s[^\W\d_a-z]\.)?(?:\s(?:{_PARTICLE_RUN})?{_CAP})?|[^\W\d_a-z]\.\s(?:{_PARTICLE_RUN})?{_CAP}")


# Common given names, a fixed list; they count with a family name behind them.
_GIVEN = (
    "adam alice andrew angela anna anne anthony barbara benjamin brian carlos carol catherine charles charlotte christine christopher claire daniel david deborah dennis diana diego donald dorothy "
    "edward eleanor elena elizabeth emily emma eric fernando francisco françois franz gary george georg günter hannah hans heather heinrich helen helmut henry ingrid isabel isabelle jacob james "
    "jane jason javier jean jennifer jessica johannes john jonathan jorge josé joseph juan julia julie jürgen karen karin katherine kenneth kevin klaus laura linda louis lucas luis manuel margaret "
    "maria maría marie martin martina matthew michael michel monika nancy nicolas nicole olivia pablo patricia patrick paul pedro peter petra philippe pierre rachel richard robert ronald ruth "
    "samuel sandra sarah sabine sebastian sophie stefan stephen steven susan sylvie teresa thomas timothy ursula walter werner william wolfgang"
).split()


def _fold(token: str) -> str:
    token = token.lower().translate({0xE4: "ae", 0xF6: "oe", 0xFC: "ue", 0xDF: "ss"})
    return "".join(c for c in unicodedata.normalize("NFD", token) if "a" <= c <= "z")


class NameParser:
    """Expands a lexicon token to the whole name."""

    def __init__(self, first: set[str], last: set[str]):
        self.first, self.last = first, last
        self.after = re.compile(rf"\s((?:[^\W\d_]\.\s?){{0,2}}(?:{_PARTICLE_RUN})?)({_TOKEN})(?![\w@+]|[.]\w)", re.I)
        self.initial = re.compile(r"\s[^\W\d_a-z]\.(?=\s|,|$)")
        self.given = set(_GIVEN) - _ORDINARY - first
        self.family = re.compile(rf"\s(?:[^\W\d_a-z]\.\s)?(?:{_PARTICLE_RUN})?([^\W\d_a-zß-öø-ÿ][^\W\d_]*[a-zß-öø-ÿ]+(?:['’\-][^\W\d_]+)*)(?![\w@+]|[.]\w)")
        self.inverted = re.compile(rf",\s(?:({_TOKEN})(?:\s[^\W\d_]\.(?!\w))?|[^\W\d_]\.(?!\w))")

    def __call__(self, text: str, low: str, start: int, end: int) -> tuple[int, int] | None:
        token = low[start:end]
        is_first, is_last = token in self.first, token in self.last
        if not is_first and not is_last:
            m = self.family.match(text, end)
            known = m and text[start].isupper() and m.group(1).lower() not in _NOT_NAMES
            return (start, m.end()) if known else None
        full = False
        if is_first:
            m = self.after.match(text, end)
            if m and "\n\n" not in m.group() and m.group(2).lower() in self.last:
                end, full = m.end(), True
            elif m := self.initial.match(text, end):
                end = m.end()  # a given name and an initial
        if not full and is_last:
            run = re.search(rf"(?<![^\W_])({_PARTICLE_RUN})$", text[max(0, start - 20) : start], re.I)
            if run:
                start -= len(run.group(1))
            initial = _INITIAL_BEFORE.search(text, max(0, start - 8), start)
            if initial:
                start, full = initial.start(), True
            m = self.inverted.match(text, end)
            if m and not initial and (m.group(1) is None or m.group(1).lower() in self.first):
                end, full = m.end(), True
        if full:
            return start, end
        if token in _ORDINARY or (token in self.first and text[start:end].islower()):
            if text[start:end].islower():
                return None if token in _ORDINARY else (start, end)
            line = text.rfind("\n", 0, start) + 1
            alone = text[line:start].strip(" >") == "" and text[end : end + 1] in ("", "\n", ",")
            if not (alone or _PERSON_BEFORE.search(text, max(0, start - 14), start) or _PERSON_AFTER.match(text, end)):
                return None
        return start, end


class Finder:
    """All parsers behind one automaton."""

    def __init__(self, lexicon: list[tuple[str, bool, bool]]):
        first = {t for t, f, _ in lexicon if f}
        last = {t for t, _, g in lexicon if g}
        self.names = NameParser(first, last)
        self.anchors = ahocorasick.Automaton()
        words: dict[str, list[tuple]] = {"://": [("scheme", None)]}
        for digit in "0123456789":
            words[digit] = [("digit", None)]
        for cue in _ID_CUES:
            words.setdefault(cue, []).append(("id", cue))
        for spelled in _AT[:5]:
            words.setdefault(spelled, []).append(("at", spelled))
        words.setdefault(" dot ", []).append(("dot", " at "))
        for streets, shape in _STREETS:
            for word in streets:
                words.setdefault(word, []).append(("street", shape))
        for cue in (*_GREETINGS, *_TITLES, "from: "):
            words.setdefault(cue, []).append(("cue", cue))
        for token in {t for t, _, _ in lexicon} | self.names.given:
            words.setdefault(token, []).append(("name", token))
        for word, uses in words.items():
            self.anchors.add_word(word, (len(word), uses))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[Span]:
        """Occurrences (start, end, kind), in order, without overlap; a mail address or street comes before a name inside it."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        mails: list[Span] = []
        streets: list[Span] = []
        names: list[tuple[int, int]] = []
        cues: list[int] = []
        digits: list[int] = []
        id_cues: list[int] = []
        schemes: list[int] = []
        for last, (size, uses) in self.anchors.iter(low):
            start, end = last + 1 - size, last + 1
            for kind, what in uses:
                if kind == "digit":
                    if not low[last - 1 : last].isdigit():
                        digits.append(last)
                elif kind == "id":
                    id_cues.append(end)
                elif kind == "scheme":
                    schemes.append(end)
                elif kind == "name":
                    if not low[start - 1 : start].isalpha() and not low[end : end + 1].isalpha() and low[start - 1 : start] not in ("-", "_") and not (low[end : end + 1] == "-" and low[end + 1 : end + 2].isalpha()):
                        names.append((start, end))
                elif kind == "street":
                    if (found := _address(text, start + (low[start].isspace()), what)) is not None:
                        streets.append(found)
                elif kind == "cue":
                    before = low[max(0, start - 2) : start]
                    if not before[-1:].isalnum() and not (what[:2] == "ms" and before[:1].isdigit()):  # milliseconds are no title
                        cues.append(end)
                elif kind == "at":
                    if (found := _mail(text, low, start, end, what, schemes)) is not None:
                        mails.append(found)
                elif (at := low.rfind(" at ", max(0, start - 40), start)) >= 0:
                    if (found := _mail(text, low, at, at + 4, " at ", schemes)) is not None:
                        mails.append(found)
        if streets:
            taken = sorted(names)
            streets = [_with_town(text, x, taken) for x in streets]
        spans = _disjoint(mails + streets)
        maybe: list[Span] = []
        for span in _numbers(text, digits, sorted(id_cues)):
            if span[2] == "maybe_id":
                maybe.append(span)
            elif (k := _free(spans, span[0], span[1])) >= 0:
                spans.insert(k, span)
        found: list[Span] = []
        done = -1
        for start, end in sorted(names, key=lambda x: (x[0], -x[1])):
            if start >= done and _free(spans, start, end) >= 0:
                whole = self.names(text, low, start, end)
                if whole and whole[0] >= done:
                    found.append((*whole, "name"))
                    done = whole[1]
        for at in cues:
            m = _FREE_NAME.match(text, at)
            if m and (w := m.group().split()[0].strip(".,").lower()) not in _NOT_NAMES and m.group().split()[-1].lower() not in _NOT_NAMES and (len(w) == 1 or not m.group().isupper() or " " in m.group()):
                if text[m.end() : m.end() + 1] in (",", ":", "\n", " ", "<", ".", ";", "!", ""):
                    found.append((m.start(), m.end(), "name"))
        out = _disjoint(spans, found)
        for start, end, _ in maybe:
            # A bare number is a person's where a name stands right before it, or follows in the same clause.
            k = _free(out, start, end)
            if k < 0:
                continue
            before = text[out[k - 1][1] : start] if k and out[k - 1][2] == "name" else None
            after = text[end : out[k][0]] if k < len(out) and out[k][2] == "name" else None
            if (before is not None and before in (", ", ": ", " (", " ")) or (after is not None and len(after) <= 24 and not any(c.isdigit() or c in "\n.;" for c in after.replace("Dr.", "").replace("Sra.", "").replace("Sr.", ""))):
                out.insert(k, (start, end, "id_number"))
        return out


def _free(spans: list[Span], start: int, end: int) -> int:
    """Where a span goes among sorted ones that do not overlap; -1 if it touches one of them."""
    k = bisect_left(spans, (start, -1, ""))
    if k < len(spans) and spans[k][0] < end or k and spans[k - 1][1] > start:
        return -1
    return k


def _disjoint(spans: list[Span], more=None) -> list[Span]:
    """The spans and those of ``more`` that touch none of them; the first in place wins among equals. With ``more``, the spans are sorted and apart already."""
    out = list(spans) if more is not None else []
    for span in more if more is not None else sorted(spans, key=lambda x: (x[0], -x[1])):
        k = _free(out, span[0], span[1])
        if k >= 0:
            out.insert(k, span)
    return out


# --- lexicon --------------------------------------------------------------------------

_AT_SIGN = re.compile(r"@|＠|\(at\)|\[at\]")
_DISPLAY = re.compile(rf"((?:{_TOKEN}|[^\W\d_]\.)(?:,?\s(?:{_TOKEN}|[^\W\d_]\.)){{1,4}})\s?[<(|]\s?$")
_BOX = re.compile(r"[\w.+%\-]+(?=\s?$)")
_HOST = re.compile(r"\s?[A-Za-z0-9\-]+(?:\.| ?[\[(]dot)")
_SMALL = {*_PARTICLES, "from", "by", "to", "cc", "mail"}


def _harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple[str, str]] = []
        for text in batch.column(0).to_pylist():
            for sign in _AT_SIGN.finditer(text):
                if not _HOST.match(text, sign.end()):
                    continue
                before = text[max(0, sign.start() - 64) : sign.start()]
                box = _BOX.search(before)
                if not box:
                    continue
                name = box.group().lower()
                rows.extend(("box", t) for t in re.split(r"[^a-z]+", name) if len(t) > 2)
                rows.append(("box", re.sub(r"[^a-z]+", "", name)))
                at = sign.start() - len(before) + box.start()
                m = _DISPLAY.search(text[max(0, at - 80) : at])
                if not m:
                    continue
                lines = m.group(1).split("\n")[-1]
                parts = lines.split(",")
                tokens = [[t for t in re.findall(_TOKEN, p.lower()) if len(t) > 2 and t not in _SMALL] for p in parts]
                if len(parts) == 2 and tokens[0] and tokens[1]:
                    rows += [("last", tokens[0][-1]), ("first", tokens[1][0])]
                elif len(parts) == 1 and len(tokens[0]) >= 2:
                    rows += [("first", tokens[0][-2]), ("last", tokens[0][-1])]
                elif len(parts) == 1 and len(tokens[0]) == 1 and re.search(r"(?<!\w)[^\W\d_]\.", lines):
                    rows.append(("last", tokens[0][0]))
        kinds, tokens = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(tokens, pa.string())], names=["kind", "token"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What mailbox names must hold for each token: its plain form, or the plain forms of all its parts."""
    for batch in batches:
        tokens, ways, plain = [], [], []
        for token in batch.column(0).to_pylist():
            parts = [_fold(p) for p in re.split(r"['’\-]", token)]
            for way, needed in ((0, [_fold(token)]), (1, parts if len(parts) > 1 else [])):
                tokens += [token] * len(needed)
                ways += [way] * len(needed)
                plain += needed
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(ways, pa.int32()), pa.array(plain, pa.string())], names=["token", "way", "plain"])


def name_lexicon(texts: DataFrame, text: str = "text") -> list[tuple[str, bool, bool]]:
    """(token, given, family) of the names that a corpus puts before mail addresses.

    Only rows with a mail address are read in Python. A token is kept when mailbox names
    hold it too, which is a join of counts. More than ``LEXICON_TOKENS`` tokens are an error.
    """
    rows = texts.where(F.col(text).rlike(r"@|\(at\)|\[at\]|＠")).select(F.col(text)).mapInArrow(_harvest, "kind string, token string")
    counts = cut(rows.groupBy("kind", "token").count())
    named = counts.where("kind <> 'box'").groupBy("token").pivot("kind", ["first", "last"]).agg(F.sum("count"))
    named = named.select("token", F.coalesce("first", F.lit(0)).alias("f"), F.coalesce("last", F.lit(0)).alias("l"))
    boxes = counts.where("kind = 'box'").select(F.col("token").alias("plain"), F.lit(1).alias("held")).distinct()
    needed = named.select("token").mapInArrow(_folded, "token string, way int, plain string")
    ways = needed.join(boxes, "plain", "left").groupBy("token", "way").agg(F.count("*").alias("n"), F.count("held").alias("held"))
    sure = named.join(ways.where("held = n").select("token").distinct(), "token")
    out = [(t, 3 * f >= g, 3 * g >= f) for t, f, g in sure.orderBy("token").limit(LEXICON_TOKENS + 1).collect()]
    if len(out) > LEXICON_TOKENS:
        raise ValueError(f"the corpus names more than {LEXICON_TOKENS} name tokens; give it in parts")
    return out


# --- operators ------------------------------------------------------------------------

_FINDERS: dict[tuple, Finder] = {}


def finder(lexicon: list[tuple[str, bool, bool]]) -> Finder:
    key = tuple(lexicon)
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(lexicon)
    return _FINDERS[key]


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*out, text[at:]])


def find_personal(texts: DataFrame, lexicon: list[tuple[str, bool, bool]], key: str, text: str) -> DataFrame:
    """``(record_id, kind, start_pos)``, one row per occurrence; positions count code points from 1.

    Null and empty texts have none. Repeated rows repeat their occurrences.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = finder(shared.value)
        for batch in batches:
            at, kinds, starts = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for start, _, kind in search(t):
                    if kind not in REPORTED:
                        continue
                    at.append(k)
                    kinds.append(kind)
                    starts.append(start + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64())], names=["record_id", "kind", "start_pos"]
            )

    source = texts.where(F.length(text) > 0).select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
    return source.mapInArrow(find, "record_id string, kind string, start_pos bigint")


def redact_personal(texts: DataFrame, lexicon: list[tuple[str, bool, bool]], key: str, text: str) -> DataFrame:
    """``(record_id, text, n_found)``: every row with its occurrences replaced by ``[NAME]`` and the like; a null text stays null."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = finder(shared.value)
        for batch in batches:
            found = [(t, search(t) if t else []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t and redact(t, s) for t, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int32())], names=["record_id", "text", "n_found"]
            )

    source = texts.select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
    return source.mapInArrow(clean, "record_id string, text string, n_found int")
