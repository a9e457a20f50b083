"""Personal information inside free text: found, located in the source, and replaced by typed placeholders.

A transducer normalises look-alike characters, removes invisible ones, and undoes spelled-out digits and at/dot disguises,
keeping for every normalised character the source characters it stands for. Detectors run on the normalised text; their
spans are mapped back, so what is reported or replaced is exactly what stands in the source.

Names and towns come from the given lexicon and from the corpus itself. A first pass counts, over all texts, which words
stand beside known names and after titles, which end an address, and how often every word is written small; what
:func:`learn` makes of the counts is joined to the lexicon. A second pass detects.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from granary.session import cut

# Characters that look like ASCII ones, one to one.
_LOOKALIKES = dict(zip("аеорсухіјѕԁАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "aeopcyxijsdABEKMHOPCTXIJSABEZHIKMNOPTYXo"))
_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_BLANKS = {c: " " for c in "               　"}
_DASHES = {c: "-" for c in "‐‑‒–−"} | {"’": "'", "ʼ": "'"}
_ONE_TO_ONE = str.maketrans(_LOOKALIKES | _WIDE | _BLANKS | _DASHES)
_ODD = re.compile("[" + re.escape("".join({**_LOOKALIKES, **_WIDE, **_BLANKS, **_DASHES})) + "]")
_INVISIBLE = "​‌‍⁠﻿­"
# Spelled digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DIGIT_WORD = "(?:" + "|".join(_DIGITS) + ")"
_AT_WORD, _DOT_WORD = "(?:at|arroba)", "(?:dot|punto|punkt|point)"
_DISGUISE = re.compile(
    rf"(?P<gone>[{_INVISIBLE}]+)"
    rf"|(?<=\w)(?P<at>\s*[\[({{<]\s*{_AT_WORD}\s*[\])}}>]\s*|\s+@\s*(?=[\w-]+(?:\.|\s*[\[({{]|\s+{_DOT_WORD}\s))|@\s+(?=[\w-]+\.)|\s+{_AT_WORD}\s+(?=[\w-]+(?:\s+{_DOT_WORD}\s+[\w-]+)+))(?=\w)"
    rf"|(?<=\w)(?P<dot>\s*[\[({{<]\s*{_DOT_WORD}\s*[\])}}>]\s*|\s+dot\s+)(?=\w)"
    rf"|(?<=\w)(?P<bare>\s+{_DOT_WORD}\s+)(?=\w)"
    rf"|\b(?P<digits>{_DIGIT_WORD}(?:[\s,-]+{_DIGIT_WORD}){{6,}})\b",
    re.I,
)
_INVISIBLE_SET = frozenset(_INVISIBLE)
#: What must stand around a bare dot word other than 'dot', an everyday word too: an at before it, or labels up to an at after it.
_AFTER_AT = re.compile(r"[^\W_]@[\w-]+\Z")
_BEFORE_AT = re.compile(rf"[\w.+-]+(?:\s+{_DOT_WORD}\s+[\w.+-]+)*(?:\s*[\[({{<]\s*{_AT_WORD}\s*[\])}}>]|\s*@\s*[\w-]|\s+{_AT_WORD}\s+[\w-]+\s+{_DOT_WORD}\s+\w)", re.I)


def _may_be_disguised(text: str) -> bool:
    """A cheap test: without these substrings the disguise pattern can't match."""
    low = text.lower()
    if " @" in low or "@ " in low or "dot" in low or "punto" in low or "punkt" in low or "point" in low or "arroba" in low:
        return True
    for b in "([{<":
        if b in low and re.search(r"[\[({<]\s*at\s*[\])}>]", low):
            return True
    if not text.isascii() and not _INVISIBLE_SET.isdisjoint(text):
        return True
    return sum(low.count(w) for w in _DIGITS) >= 7


class Normal:
    """A normalised text with the way back: ``source(a, b)`` gives the source span of a normalised span."""

    __slots__ = ("text", "starts", "shifts", "ends")

    def __init__(self, raw: str):
        same = raw.translate(_ONE_TO_ONE) if not raw.isascii() and _ODD.search(raw) else raw
        self.starts: list[int] | None = None
        if not _may_be_disguised(same):
            self.text = same
            return
        out, pos, at = [], 0, 0
        self.starts, self.shifts, self.ends = [0], [0], [0]  # piece starts, their source starts, source ends of replaced pieces or 0

        def piece(text: str, start: int, end: int) -> None:
            nonlocal at
            if text:
                out.append(text)
                self.starts.append(at)
                self.shifts.append(start)
                self.ends.append(end)
                at += len(text)

        in_domain = -1  # where the label begins that follows an at or dot of a domain
        for m in _DISGUISE.finditer(same):
            if m["bare"]:
                after = in_domain >= 0 and re.fullmatch(r"[\w-]+", same[in_domain : m.start()]) or _AFTER_AT.search(same, max(0, m.start() - 80), m.start())
                if not after and not _BEFORE_AT.match(same, m.end()):
                    continue
                in_domain = m.end() if after else -1
            elif m["at"] or m["dot"] and in_domain >= 0:
                in_domain = m.end()
            piece(same[pos : m.start()], pos, 0)
            if m["at"]:
                new = "@"
            elif m["dot"] or m["bare"]:
                new = "."
            elif m["digits"]:
                new = "".join(_DIGITS[w.lower()] for w in re.findall(_DIGIT_WORD, m["digits"], re.I))
            else:
                new = ""
            piece(new, m.start(), m.end())
            pos = m.end()
        piece(same[pos:], pos, 0)
        self.text = "".join(out)

    def source(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        start = self.shifts[i] if self.ends[i] else self.shifts[i] + a - self.starts[i]
        end = self.ends[j] if self.ends[j] else self.shifts[j] + b - self.starts[j]
        return start, end


# --- identifiers -------------------------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+@-])[^\W_][\w.+'-]*@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}")

#: Words before a number that make it something else than a phone or identity number, unless no serial has its shape.
_NOT_PERSONAL = re.compile(r"(?:\b(?:lots?|sn|ean|lt|serial|article|art|ticket|run|lauf|charge|batch|lote|hash|version|tool|order|invoice no|item|sku|part)\b[.:#\s-]*(?:no\.?|number|nr\.?)?\s*|[#$€£]\s*)$", re.I)

_PHONE = re.compile(
    r"(?<![\w+.,/#-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,7}){1,5}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
    r"|\d{3}([ .-])\d{3}\1\d{4}"
    r"|0\d{1,4} ?/ ?\d{2,4}[ -]?\d{3,6}"
    r"|0\d{9,10}"
    r")(?:,?\s*(?:ext\.?|extension|x|durchwahl|poste)\s*\.?\s*\d{1,6})?(?![\w-]|[.,/]\d)"
)

#: Phones by their shape alone: with a country's prefix, an area in brackets or an extension.
_SURELY_PHONE = re.compile(r"\+|\(|.*[a-z]")

_ID_LABEL = (
    r"(?:passport|passeport|pasaporte|reisepass(?:nummer)?|social\s+security|national\s+id(?:entity)?(?:\s+card)?|tax\s+(?:id|file)|identity\s+card|id\s+card|"
    r"(?:personal)?ausweis(?:nummer|nr\.?)?|(?:national\s+)?(?:identity|identification)\s+(?:number|no)|steuer-?(?:id|nummer)|documento\s+de\s+identidad|(?:pi[eè]ce|carte)\s+d['’]identit[eé]|s[eé]curit[eé]\s+sociale|seguridad\s+social|dni|nif|nie|ssn|tfn|nino)"
)
_ID_SHAPES = (
    r"\d{3}([ -])\d{2}\{g}\d{4}",
    r"\d{4} \d{4} \d{4}",
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    r"\d{6}-\d{4,5}",
    r"\d{1,2}\.\d{3}\.\d{3}-[\dA-Z]",
    r"[XYZ]\d{7,8}[A-Z]",
)
#: The shapes' letter classes in lower case.
_SMALL = str.maketrans("AZDXY", "azdxy")
_GENERIC_ID = r"[A-Z]{0,3} ?\d+(?:[ .\-/]\d+)*(?:-?[A-Z])?"
_LABELLED_ID = re.compile(rf"\b{_ID_LABEL}[\s.:=#]*(?:(?:no|number|nr|num|n[°º]|card)\b[\s.:=#]*)?(?:(?:is|was|ist|lautet|es|est)\b\s*)?[:=]?\s*(?P<id>{'|'.join(s.replace('{g}', str(i + 2)) for i, s in enumerate(_ID_SHAPES)).translate(_SMALL)}|{_GENERIC_ID.translate(_SMALL)})(?!\w|[.,-]\d)")
_SHAPED_ID = re.compile(rf"(?<![\w.+/#-])(?P<id>{'|'.join(s.replace('{g}', '2') for i, s in enumerate(_ID_SHAPES) if i != 1)})(?!\w|[.,/-]\w)")

_WORD = r"[^\W\d_][^\W\d_'-]*(?:['-][^\W\d_]+)*"
_CAP = rf"(?-i:[A-ZÀ-ÖØ-Þ])[^\W\d_]*(?:['-][^\W\d_]+)*"
_CAP2 = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:['-][^\W\d_]+)*"
_STREET_END = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|close|way|court|ct\.?|place|crescent|terrace|boulevard|blvd\.?|square|grove|hill|row|walk|mews)"
_STREET = (
    rf"\d{{1,4}}[A-Z]?\s+(?:{_WORD}\s+){{1,3}}?{_STREET_END}(?!\w)"
    rf"|\d{{1,4}}(?:\s?(?:bis|ter|[A-Z]))?,?\s+(?:rue|avenue|allée|chemin|impasse|boulevard|place|quai|route)\s+(?:(?:du|des|de\s+la|de\s+l'|de|d')\s*)?{_CAP}"
    rf"|(?:calle|avda\.?|avenida|plaza|paseo|camino|c/|via|viale|piazza|corso|rua|largo)\s+(?:(?:del|de\s+la|de\s+los|de\s+las|della|dei|do|da|de)\s+)?{_CAP}(?:\s+{_CAP})?,?\s+\d{{1,4}}[A-Z]?\b"
    rf"|(?:(?:am|an\s+der|im|auf\s+dem|zum|zur)\s+{_CAP}|(?-i:[A-ZÀ-ÖØ-Þ])[^\W\d_]*(?:-[^\W\d_]+)*(?<=..)(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|straat|laan|gracht))\s*\d{{1,4}}[A-Z]?\b"
    r"|(?:p\.?\s?o\.?\s*box|postfach|apartado)\s+\d{1,6}"
)
#: An address up to where the town begins.
_ADDRESS = re.compile(rf"(?<![\w./#-])(?:(?:flat|apt\.?|apartment|unit|suite)\s+\d{{1,4}}[A-Z]?\s*,\s*)?(?:{_STREET})(?:\s*,\s*|\s*\r?\n\s*)(?P<code>\d{{4,5}}\s+)?(?=[^\W\d_])", re.I)
_OUTER_CODE = re.compile(r",?\s+[A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2}\b", re.I)
_TOWN_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_CLOSES = re.compile(r"\s*(?:[.,;)\r\n]|$)|,?\s+[A-Z]{1,2}\d")

_DIGIT = re.compile(r"\d")
#: Where an address can begin, in lower-cased text.
_ADDRESS_START = re.compile(r"(?<![\w./#-])(?:\d{1,4}(?:\s?(?:bis|ter|[a-z]))?,?\s+(?=[^\W\d_][^\d\n,]{1,60}[,\r\n])|flat|ap|unit|suite|calle|av|plaza|paseo|camino|c/|via|piazza|corso|rua|largo|am\s|an\s|im\s|auf\s|zu|p\.?\s?o|postfach|[^\W\d_]+(?:-[^\W\d_]+)*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|straat|laan|gracht)\s)")


def _town(text: str, at: int, coded: bool, model: Model) -> int:
    """Where the town that begins at ``at`` ends with its postcode, or 0 if none does.

    A known town counts in any letter case; another needs a capital, or a postcode before or after it. A second word belongs
    to it if both together are known, or if it has a capital and closes the address or is no everyday word.
    """
    first = _TOWN_WORD.match(text, at)
    end, name, capital = first.end(), first[0].lower(), first[0][0].isupper()
    outer = _OUTER_CODE.match(text, end)
    second = _TOWN_WORD.match(text, end + 1) if not outer and text[end : end + 1] in (" ", "\xa0") else None
    sure = coded or name in model.towns
    if second:
        w, stop = second[0].lower(), second.end()
        closes = _CLOSES.match(text, stop)
        if f"{name} {w}" in model.towns or capital and second[0][0].isupper() and (closes or w not in model.common and w not in model.given and not first[0].isupper()):
            end, sure = stop, sure or f"{name} {w}" in model.towns
            outer = _OUTER_CODE.match(text, end)
    return outer.end() if outer else end if capital or sure else 0


def _addresses(text: str, low: str, model: Model) -> Iterator[tuple[int, int, int]]:
    """Start of each address, of its town, and its end."""
    end = 0
    for m in _ADDRESS_START.finditer(low):
        if m.start() >= end and (found := _ADDRESS.match(text, m.start())):
            stop = _town(text, found.end(), found["code"] is not None, model)
            if stop:
                end = stop
                yield m.start(), found.end(), end


#: What every address has: a number next to a word, then a comma or line end before the town.
_HOUSE = re.compile(r"\d[A-Za-z]?(?:\s|,)[^\d]{0,60}?[,\n]|\d[A-Za-z]?\s*[,\n]")
_STREET_WORDS = ("street", "st.", " st", "road", " rd", "ave", "lane", " ln", "drive", " dr", "close", "way", "court", " ct", "place", "crescent", "terrace", "boulevard", "blvd", "square", "grove", "hill", " row", "walk", "mews", "rue", "allée", "chemin", "impasse", "quai", "route", "calle", "avda", "plaza", "paseo", "camino", "c/", "via", "piazza", "corso", "rua ", "largo", "am ", "an der", "im ", "auf dem", "zum ", "zur ", "straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "straat", "laan", "gracht", "box", "postfach", "apartado")
_ID_WORDS = ("pass", "pasaporte", "securit", "sécurit", "seguridad", "national", "tax", "card", "ausweis", "steuer", "identi", "dni", "nif", "nie", "ssn", "tfn", "nino")


def _may_hold_address(text: str, low: str) -> bool:
    return any(w in low for w in _STREET_WORDS) and _HOUSE.search(text) is not None


# --- names -------------------------------------------------------------------------------------------------------------

_PARTICLE = r"(?:van|von|der|den|de|del|della|di|la|le|du|dos|da)"
_PARTICLES = frozenset("van von der den de del della di la le du dos da".split())
_INITIAL = r"[^\W\d_]\."


def _name(gap: str = r"\s+", word: str = _WORD) -> str:
    """Pattern of a full name: given or initial, middle, family with particles; or family, given."""
    family = rf"(?:{_PARTICLE}{gap}){{0,3}}{word}"
    initials = rf"{_INITIAL}(?:\s?{_INITIAL})?"
    return rf"(?:{family},{gap}(?:{word}(?:{gap}(?:{_INITIAL}|{word}))?|{initials})|(?:{initials}|{word}(?:{gap}(?:{_INITIAL}|{word}))?){gap}{family})"


#: Signatures stand on one line.
_ON_LINE = _name(r"[^\S\r\n]+")
_PROPER_TITLE = r"(?-i:Mrs|Mr|Ms|Miss|Dr|Prof|Frau|Herrn?|Señora|Señor|Sra|Sr|Mme|Mlle|MRS|MR|MISS|DR|PROF|FRAU|HERRN?)\.?\s+"
_TITLE_WORDS = ("Mr", "Ms", "Miss", "Dr", "Prof", "Frau", "Herr", "Señor", "Sr", "Mme", "Mlle", "MR", "MISS", "DR", "PROF", "FRAU", "HERR")
_TITLED = re.compile(rf"\b{_PROPER_TITLE}(?P<name>(?:{_INITIAL}|(?-i:[A-ZÀ-Þ])[^\W\d_'-]*(?:['-][^\W\d_]+)*)(?:\s+(?:{_INITIAL}|{_CAP}))?\s+(?:{_PARTICLE}\s+){{0,3}}{_CAP})", re.I)
#: What ends a letter: after it a line of two to four words is a name.
_FAREWELL = r"(?:(?:kind|best|warm|with\s+kind)\s+regards|regards|(?:best|warm|all\s+good)\s+wishes|all\s+the\s+best|yours(?:\s+(?:sincerely|truly|faithfully))?|(?:sincerely|truly|faithfully)(?:\s+yours)?|(?:many\s+)?thanks|thank\s+you|cheers|mit\s+\w+\s+grüßen|(?:viele|liebe|beste|freundliche|herzliche)\s+grüße|cordialement|bien\s+à\s+vous|salutations|(?:un\s+)?(?:cordial\s+)?saludos?|atentamente)"
_SIGNED = re.compile(rf"(?:\b{_FAREWELL}[,.!]?[ \t]*\r?\n\s*|(?:^|\n)--[ \t]*\r?\n)(?P<name>{_ON_LINE})[ \t]*(?=\r?\n|$|\|)", re.I)
_FAREWELL_WORDS = ("regard", "wishes", "best", "yours", "sincerely", "truly", "faithfully", "thank", "cheers", "grüße", "cordialement", "bien à", "salutations", "saludo", "atentamente", "--")
_LINE_NAME = re.compile(rf"(?:^|\n)[ \t]*(?P<name>{_ON_LINE})[ \t]*\r?\n", re.I)
_TOKEN = re.compile(rf"{_WORD}")
_SPACED = re.compile(r"\s+")
#: What may stand before a person's name: roles, then verbs, prepositions and greetings, in four languages.
_ROLES = frozenset(
    "agent assistant attn author boss buyer client colleague consultant contact courier customer director doctor driver engineer farmer foreman friend gardener grower inspector labeller manager neighbour nurse "
    "operator owner packer partner photographer picker researcher reviewer secretary seller sender signed student supervisor teacher technician trainee visitor worker ansprechpartner chef einkäufer erntehelfer "
    "fahrer kollege kollegin kunde kundin leiter leiterin prüfer prüferin verkäufer winzer acheteur cliente client chauffeur collègue directeur directrice responsable comprador compradora jefe jefa encargado encargada".split()
)
_LEADS = frozenset("ask asked by call called contact cc dear emailed from hello hi met meet phone phoned tell told thank thanks to with an mit von frag fragen bei contactez demandez avec par pregunte pregunta llame con por señor señora".split())
#: What may stand after it.
_DEEDS = frozenset("agreed answered arrived asked called came confirmed emailed explained has left lives moved noted phoned promised replied reported said says sent signed told took visited wants was will wrote works sagte schrieb wohnt hat arbeitet habite travaille dit écrit vive trabaja dijo escribió".split())
#: Words that make a family name before them a firm, and everyday words that are also names.
_FIRM = frozenset("orchards orchard logistics growers packing cooperative lab laboratory store stores fruit fruits imaging cold packhouse farms farm ltd gmbh inc co corp ag sa plc llc bank sons bros brothers group crates trays company holdings foods market university institute".split())
_EVERYDAY = frozenset("gold lane rose winter miller pippin amber jade olive summer hazel ruby grace will may april june frank mark baker green brown white black field wood king".split())
_TITLES = frozenset("mrs mr ms miss dr prof frau herr herrn señora señor sra sr mme mlle".split())


def _shorter(word: str) -> set[str]:
    """The word and what is left of it without any one letter."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


#: Long everyday words, and those of firms, with one slip: 'Wintre' is no given name. Short ones are too near to names (may, Mary).
_SLIPS = frozenset().union(*(_shorter(w) for w in _EVERYDAY if len(w) > 5), *(_shorter(w) for w in _FIRM if len(w) > 4))


def _plain(token: str) -> str:
    return _SPACED.sub(" ", token.strip().translate(_ONE_TO_ONE).lower())


class Model:
    """Known given and family names, towns, and everyday words; names that are everyday words need a known partner."""

    def __init__(self, rows: Iterable[tuple[str, str]]):
        kinds: dict[str, set[str]] = {"given": set(), "family": set(), "town": set(), "common": set()}
        for token, kind in rows:
            if token and token.strip() and kind in kinds:
                kinds[kind].add(_plain(token))
        self.given, self.family, self.towns, self.common = kinds["given"], kinds["family"], kinds["town"], kinds["common"]
        self.known = self.given | self.family
        #: Family names of several words, with a particle in front and without.
        self.prefixed = {f for f in self.family if " " in f and f.split(" ")[0] in _PARTICLES}
        self.phrases = [f for f in self.family if " " in f and f.split(" ")[0] not in _PARTICLES]
        self.ends = frozenset(f.rsplit(" ", 1)[1] for f in self.prefixed)

    def ordinary(self, word: str) -> bool:
        """An everyday word, or one slip from a long one."""
        return word in _FIRM or word in _EVERYDAY or word in _TITLES or word in self.common or not _SLIPS.isdisjoint(_shorter(word))

    def likely(self, name: str) -> bool:
        """Whether the words of a line or cue may be a name: none but initials and particles is an everyday word that no
        lexicon knows."""
        words = [w.lower() for w in _TOKEN.findall(name)]
        long = [w for w in words if len(w) > 1 and w not in _PARTICLES]
        return bool(long) and all(w in self.known or not self.ordinary(w) for w in long)

    def unknown_given(self, text: str, words: list, k: int) -> bool:
        """Whether a word that the lexicon lacks may be a given name: capitalised inside a sentence, not all capitals, no title, firm or everyday word."""
        a, b, w = words[k]
        return text[a].isupper() and b - a > 2 and not text[a:b].isupper() and w not in self.known and w not in _PARTICLES and not self.ordinary(w) and not _opens(text, words, k) and text[:a].rstrip()[-1] not in "'\">|*-"

    def spans(self, text: str, words: list) -> Iterator[tuple[int, int]]:
        """Names found by their parts: given and family name side by side, in either order, with middle names or initials."""
        given, family = self.given, self.family
        n = len(words)
        for i, (a, b, w) in enumerate(words):
            if w in family or w in self.ends:
                start, j = a, i - 1
                while j >= 0 and words[j][2] in _PARTICLES and text[words[j][1] : start].isspace():
                    start, j = words[j][0], j - 1
                if w not in family and _SPACED.sub(" ", text[start:b].lower()) not in self.prefixed or w in _EVERYDAY:
                    continue
                nxt = words[i + 1] if i + 1 < n else None
                if nxt and nxt[2] in _FIRM and text[b : nxt[0]].isspace():
                    continue
                # initials or a given name before it
                if j >= 0:
                    gap, p = text[words[j][1] : start], words[j]
                    if gap.strip() == "." and p[1] - p[0] == 1 and gap != "." and not (p[2] == "o" and text[max(0, p[0] - 2) : p[0]].lower() == "p.") and not _measured(text, p[0]):
                        q = words[j - 1] if j else None
                        if q and text[q[1] : p[0]].isspace() and (q[2] in given or text[q[0]].isupper() and q[2] not in family and q[1] - q[0] > 2 and not self.ordinary(q[2]) and not _opens(text, words, j - 1)):
                            yield q[0], b
                        elif q and q[1] - q[0] == 1 and text[q[1] : p[0]].strip() == "." and "\n" not in text[q[1] : p[0]] and not _measured(text, q[0]):
                            yield q[0], b
                        else:
                            yield p[0], b
                        continue
                    if gap.isspace() and p[2] in given:
                        q = words[j - 1] if j else None
                        yield (q[0] if q and q[2] in given and text[q[1] : p[0]].isspace() else p[0]), b
                        continue
                    if gap.isspace() and j and words[j - 1][2] in given and text[words[j - 1][1] : p[0]].isspace() and p[2] not in family and text[p[0]].isupper():
                        yield words[j - 1][0], b
                        continue
                    # an unknown one: its capital tells something, the family name has one too and is nothing else
                    if gap.isspace() and "\n" not in gap and w not in given and text[a].isupper() and self.unknown_given(text, words, j):
                        yield p[0], b
                        continue
                # family name, given name
                if nxt and re.fullmatch(r",\s+", text[b : nxt[0]]) and (nxt[2] in given or nxt[1] - nxt[0] == 1 and text[nxt[1] : nxt[1] + 1] == "."):
                    end = nxt[1] + (nxt[1] - nxt[0] == 1)
                    third = words[i + 2] if i + 2 < n else None
                    if third and text[nxt[1] : third[0]].isspace() and third[1] - third[0] == 1 and text[third[1] : third[1] + 1] == ".":
                        end = third[1] + 1
                    elif third and text[nxt[1] : third[0]].isspace() and third[2] in given and nxt[1] - nxt[0] > 1 and "\n" not in text[nxt[1] : third[0]]:
                        end = third[1]
                    yield start, end
            elif w in given and w not in _EVERYDAY and i + 1 < n:
                # a known given name before a capitalised unknown family name
                found = self.after_given(text, words, i)
                if found:
                    yield a, found[1]
        for f in self.phrases:
            if f in text.lower():
                for m in re.finditer(rf"(?P<g>{_WORD}|{_INITIAL})\s+" + r"\s+".join(map(re.escape, f.split(" "))), text, re.I):
                    if m["g"].lower() in given or m["g"].endswith("."):
                        yield m.span()

    def after_given(self, text: str, words: list, i: int) -> tuple[int, int] | None:
        """The capitalised word after given name ``i``, with particles, that may be a family name unknown so far."""
        n, at = len(words), i + 1
        c, d, x = words[at]
        gap = text[words[i][1] : c]
        start = c
        if d - c == 1 and gap.isspace() and text[d : d + 1] == "." and i + 2 < n and text[d + 1 : words[i + 2][0]].isspace():
            at = i + 2
            start = words[at][0]
        elif not gap.isspace():
            return None
        while words[at][2] in _PARTICLES and at + 1 < n and text[words[at][1] : words[at + 1][0]].isspace():
            at += 1
        c, d, x = words[at]
        firm = at + 1 < n and words[at + 1][2] in _FIRM and text[d : words[at + 1][0]].isspace()
        if x in self.known or not text[c].isupper() or d - c <= 2 or self.ordinary(x) or firm or "\n" in gap:
            return None
        return start, d

    def cued(self, text: str, words: list) -> Iterator[tuple[int, int]]:
        """Two capitalised words that no lexicon knows, between what may stand before a person's name and after it."""
        for i in range(1, len(words) - 1):
            a, b, w = words[i]
            before = words[i - 1]
            role, lead = before[2] in _ROLES, before[2] in _LEADS
            if not (role or lead) or not text[a].isupper() or text[a:b].isupper() or not re.fullmatch(r"[:,]?[^\S\r\n]+", text[before[1] : a]):
                continue
            j = i + 1
            while j + 1 < len(words) and (words[j][2] in _PARTICLES or words[j][1] - words[j][0] == 1 and text[words[j][1]] == "."):
                j += 1
            c, d, x = words[j]
            inner = text[b:c]
            if not re.fullmatch(r"(?:[^\S\r\n]+(?:\w+\.?[^\S\r\n]+)*)", inner) or not text[c].isupper() or text[c:d].isupper():
                continue
            if b - a < 3 or d - c < 3 or not text[a + 1 : b].islower() or not text[c + 1 : d].replace("'", "").replace("-", "").islower() and "-" not in text[c:d] or any(y in self.known and y not in _EVERYDAY or self.ordinary(y) or y in self.towns for y in (w, x)):
                continue
            after = words[j + 1] if j + 1 < len(words) and text[d : words[j + 1][0]].isspace() else None
            if after and (text[after[0]].isupper() or after[2] in _FIRM):
                continue
            if role or after is None or after[2] in _DEEDS or after[2] in self.common:
                yield a, d


def _measured(text: str, at: int) -> bool:
    """Whether a number stands before: then a letter is a unit, no initial."""
    return text[max(0, at - 3) : at].rstrip()[-1:].isdigit()


def _opens(text: str, words: list, k: int) -> bool:
    """A word that starts a sentence, so that its capital tells nothing."""
    before = text[: words[k][0]].rstrip()
    return not before or before[-1] in ".!?:\n"


def _words(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in _TOKEN.finditer(text)]


# --- what the corpus teaches -------------------------------------------------------------------------------------------


def evidence(text: str, model: Model) -> tuple[set[str], set[str], set[tuple[str, str]]]:
    """Words of a text, once each: all, those written small, and ``(kind, word)``: ``firm`` for words that a firm's word
    follows; ``given``, ``family`` and ``town`` for words that stand where one does, beside a name of ``model``, after a title,
    or at the end of an address, ``after`` for those after a family name and a comma, where other things stand too."""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_ONE_TO_ONE)
    found = _TOKEN.findall(text)
    low = set(map(str.lower, found))
    small = low.intersection(found)
    seen = set()
    if not low.isdisjoint(_FIRM):
        seen |= {("firm", a.lower()) for a, b in zip(found, found[1:]) if b.lower() in _FIRM}
    if not low.isdisjoint(model.known):
        words = _words(text)
        for i, (a, b, w) in enumerate(words):
            if w in model.family and w not in _EVERYDAY:
                p = words[i - 1] if i else None
                if p and text[p[1] : a].isspace() and p[2] not in model.known and p[1] - p[0] > 2 and text[p[0]].isupper() and not model.ordinary(p[2]):
                    seen.add(("given", p[2]))
                n = words[i + 1] if i + 1 < len(words) else None
                if n and re.fullmatch(r",[^\S\r\n]+", text[b : n[0]]) and n[2] not in model.known and n[1] - n[0] > 2 and text[n[0]].isupper() and not model.ordinary(n[2]):
                    seen.add(("after", n[2]))
            elif w in model.given and w not in _EVERYDAY:
                if i + 1 < len(words) and (span := model.after_given(text, words, i)):
                    seen.add(("family", _SPACED.sub(" ", text[span[0] : span[1]].lower())))
                p = words[i - 1] if i else None
                if p and re.fullmatch(r",[^\S\r\n]+", text[p[1] : a]) and p[2] not in model.known and p[1] - p[0] > 2 and text[p[0]].isupper() and not model.ordinary(p[2]):
                    seen.add(("family", p[2]))
    if any(w in text for w in _TITLE_WORDS):
        for m in _TITLED.finditer(text):
            parts = m["name"].split()
            if len(parts[0]) > 2:
                seen.add(("given", parts[0].lower()))
            seen.add(("family", parts[-1].lower()))
    plain = text.lower()
    if _DIGIT.search(text) and len(plain) == len(text) and _may_hold_address(text, plain):
        for _, at, _ in _addresses(text, plain, model):
            first = _TOWN_WORD.match(text, at)
            if first[0][0].isupper():
                second = _TOWN_WORD.match(text, first.end() + 1) if text[first.end() : first.end() + 1] == " " else None
                if _CLOSES.match(text, first.end()):
                    seen.add(("town", first[0].lower()))
                elif second and second[0][0].isupper() and _CLOSES.match(text, second.end()):
                    seen.add(("town", f"{first[0]} {second[0]}".lower()))
    return low, small, seen


def learn(docs: DataFrame, text: str, lexicon: DataFrame, least: int = 2, share: float = 0.2, everyday: float = 0.0002, most_bytes: int = 16 << 20) -> DataFrame:
    """``(token, kind)``: the lexicon's names, and those, towns and everyday words (``common``) that the corpus teaches.

    A word is learned as a name if at least ``least`` texts, a millionth of all and ``share`` of those that hold it, other than
    as part of a firm, have it where a name stands; a town likewise without the share; a word is everyday if it is written small in half its texts and in
    the share ``everyday`` of all. These shares bound each kind's number whatever the size of the corpus: at most a million
    times the mean number of such places in a text, and ``1 / everyday`` times the mean number of words. All texts are counted;
    counts are added up in each batch before anything is shuffled.
    """
    plain = F.lower(F.regexp_replace(F.trim(_one_to_one(F.col("token"))), r"(?U)\s+", " "))
    known = cut(lexicon.where("kind in ('given', 'family')").select(plain.alias("token"), "kind").where("token <> ''").distinct())
    source, rows = _with_facts(docs.select(F.lit(0).alias("key"), F.col(text).alias("__text")), known, most_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Model(rows) if rows is not None else None
        for batch in batches:
            every, small, facts = Counter(), Counter(), Counter()
            texts = [(t, m) for t, m in zip(batch.column(1).to_pylist(), _models(batch, shared)) if t]
            for t, m in texts:
                words, low, seen = evidence(t, m)
                every.update(words)
                small.update(low)
                facts.update(seen)
            kinds = ["any"] * len(every) + ["small"] * len(small) + [k for k, _ in facts] + ["texts"]
            tokens = [*every, *small, *(w for _, w in facts), ""]
            counts = [*every.values(), *small.values(), *facts.values(), len(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(tokens), pa.array(counts, pa.int64())], names=["kind", "word", "n"])

    counted = source.mapInArrow(count, "kind string, word string, n bigint")
    wide = counted.groupBy("word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("any", "small", "firm", "given", "after", "family", "town", "texts")])
    wide = cut(wide.where("given + family + town + texts > 0 or small >= 2"))
    texts = wide.agg(F.max("texts").alias("n")).first()["n"] or 0
    floor = max(least, texts / 1_000_000)
    # a name of several words isn't counted as a word; its last word's texts hold it
    named = lambda n: (n >= floor) & ((n >= share * (F.col("any") - F.col("firm"))) | F.col("word").contains(" "))
    given = F.when(F.col("given") > 0, F.col("given") + F.col("after")).otherwise(0)
    facts = F.array(
        F.when(named(given) & (given >= F.col("family")), "given"), F.when(named(F.col("family")) & (F.col("family") > given), "family"), F.when(F.col("town") >= floor, "town"),
        F.when((F.col("small") * 2 >= F.col("any")) & (F.col("small") >= max(3, everyday * texts)), "common"),
    )
    learned = wide.where("word <> ''").select(F.col("word").alias("token"), F.explode(F.array_compact(facts)).alias("kind"))
    return known.unionByName(learned.join(known.select("token").distinct(), "token", "left_anti").unionByName(learned.join(known.select("token").distinct(), "token", "left_semi").where("kind in ('town', 'common')"))).distinct()


def find_spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Non-overlapping ``(start, end, kind)`` in source positions, in order of place."""
    norm = Normal(text)
    t = norm.text
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    taken: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, kind))

    if "@" in t:
        for m in _EMAIL.finditer(low):
            add(*m.span(), "email")
    if _DIGIT.search(t) is not None:
        if any(w in low for w in _ID_WORDS):
            for m in _LABELLED_ID.finditer(low):
                add(*m.span("id"), "id_number")
        if _may_hold_address(t, low):
            for a, _, b in _addresses(t, low, model):
                add(a, b, "address")
        for m in _PHONE.finditer(low):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 21 and (_SURELY_PHONE.match(m[0]) or not _NOT_PERSONAL.search(t, max(0, m.start() - 24), m.start())):
                add(*m.span(), "phone")
        for m in _SHAPED_ID.finditer(t):
            if not _NOT_PERSONAL.search(t, max(0, m.start() - 24), m.start()):
                add(*m.span("id"), "id_number")
    names: list[tuple[int, int]] = []
    if any(w in t for w in _TITLE_WORDS):
        names += [m.span("name") for m in _TITLED.finditer(t)]
    if any(w in low for w in _FAREWELL_WORDS):
        names += [m.span("name") for m in _SIGNED.finditer(t) if model.likely(m["name"])]
    if taken and "\n" in t:
        names += [s for s in _signatures(t, taken) if model.likely(t[s[0] : s[1]])]
    words = _words(t)
    found = {w for _, _, w in words}
    if not model.known.isdisjoint(found) or not model.ends.isdisjoint(found) or any(f in low for f in model.phrases):
        names += model.spans(t, words)
    if not _ROLES.isdisjoint(found) or not _LEADS.isdisjoint(found):
        names += model.cued(t, words)
    for a, b in sorted(names, key=lambda s: (s[0] - s[1], s[0])):
        head = t[a:b].split()
        if head and head[-1].lower().strip(".,") not in _FIRM:
            add(a, b, "name")
    return sorted((*norm.source(a, b), kind) for a, b, kind in taken)


def _signatures(t: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Names alone on a line above an address, a phone or an email, or above one more line and a phone."""
    firsts = {a: kind for a, b, kind in taken}
    for m in _LINE_NAME.finditer(t):
        nxt = m.end()
        if firsts.get(nxt) in ("address", "phone", "email"):
            yield m.span("name")
        elif firsts.get(nxt) is None:
            line_end = t.find("\n", nxt)
            if 0 < line_end - nxt < 60 and firsts.get(line_end + 1) == "phone":
                yield m.span("name")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by its kind in brackets; all other characters stay."""
    out, pos = [], 0
    for a, b, kind in spans:
        out += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join([*out, text[pos:]])


def personal_information(docs: DataFrame, key: str, text: str, lexicon: DataFrame, replace: bool = False, most_bytes: int = 16 << 20) -> DataFrame:
    """``(key, kind, found_text)`` for each distinct piece in each text, or with ``replace`` ``(key, text)`` with placeholders.

    ``lexicon`` has ``token`` and ``kind`` (given, family); :func:`learn` adds what the corpus teaches. Null and empty texts
    have no finding; a null text stays null when replaced. Repeated rows repeat their findings. Each text is handled whole,
    inside its task. What is known goes to every task while its measured size is at most ``most_bytes``; beyond that it is
    joined by word, so that each text comes with the entries that its own words name.
    """
    facts = cut(learn(docs, text, lexicon, most_bytes=most_bytes))
    source, rows = _with_facts(docs.select(F.col(key), F.col(text).alias("__text")), facts, most_bytes)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Model(rows) if rows is not None else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = _models(batch, shared)
            if replace:
                out = [t if not t else redact(t, find_spans(t, m)) for t, m in zip(texts, own)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])
                continue
            at, kinds, found = [], [], []
            for i, (t, m) in enumerate(zip(texts, own)):
                if t:
                    for k, s in dict.fromkeys((k, t[a:b]) for a, b, k in find_spans(t, m)):
                        at.append(i)
                        kinds.append(k)
                        found.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=[key, "kind", "found_text"])

    return source.mapInArrow(run, f"`{key}` {kind}, `{text}` string" if replace else f"`{key}` {kind}, kind string, found_text string")


def _one_to_one(c: Column) -> Column:
    return F.translate(c, "".join(chr(x) for x in _ONE_TO_ONE), "".join(_ONE_TO_ONE[x] for x in _ONE_TO_ONE))


def _with_facts(source: DataFrame, facts: DataFrame, most_bytes: int) -> tuple[DataFrame, list | None]:
    """``source`` and the entries for its tasks, all of them while their measured size allows; else ``source`` with ``__facts``,
    for each text the entries whose last word it holds (equal texts share one list), and None."""
    size = facts.agg(F.coalesce(F.sum(F.octet_length("token") + 16), F.lit(0)).alias("b")).first()["b"]
    if size <= most_bytes:
        return source, [(r["token"], r["kind"]) for r in facts.collect()]
    words = F.regexp_extract_all(F.lower(_one_to_one(F.col("__text"))), F.lit(r"[\p{L}]+(?:['-][\p{L}]+)*"), 0)
    tagged = source.withColumn("__h", F.xxhash64("__text"))
    mine = tagged.where("__text is not null").select("__h", F.explode(F.array_distinct(words)).alias("w")).distinct()
    last = facts.select("token", "kind", F.element_at(F.split("token", " "), -1).alias("w"))
    lists = mine.join(last, "w").groupBy("__h").agg(F.collect_list(F.struct("token", "kind")).alias("__facts"))
    return tagged.join(lists, "__h", "left").select(source.columns[0], "__text", "__facts"), None


def _models(batch: pa.RecordBatch, shared: Model | None) -> list[Model]:
    """A model for each text of a batch: the shared one, or one of its own entries."""
    if shared is not None:
        return [shared] * batch.num_rows
    return [Model((f["token"], f["kind"]) for f in facts or ()) for facts in batch.column(2).to_pylist()]
