"""Personal information in free text (problem 2): anchors found by an automaton, items by local parsers.

One Aho-Corasick automaton finds at-signs, schemes, digits, cues of identifiers and addresses, titles and name parts.
Every parser starts at the place of an anchor and looks a few words to either side; no text is searched without one.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.names import GIVEN
from palimpsest.session import cut
from palimpsest.sources.tables import table

#: Name parts that one pass holds on the driver and in each Python worker (about 100 bytes each); more are looked for in several passes.
PASS_NAMES = 200_000

# Titles before names, in four languages.
TITLES = "mr mrs ms miss dr prof sir herr frau mme mlle monsieur madame sr sra srta señor señora don doña doctor".split()
# Given names that are also English words or months; alone they need a context.
WORDY = "may mark hope grace rose will bill art june april august dawn faith joy ivy jack frank sue pat rob drew chase miles ray dean olive iris sandy penny victor christian max rich grant wade clay cliff heath reed dale glen lane holly daisy lily violet ruby pearl amber jade summer autumn".split()
# Public top-level domains that look like file endings never end an address.
FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp pdf txt md csv json xml html htm js css py zip gz tar log exe dll mp3 mp4 wav doc docx xls xlsx ppt".split())

_LETTER = r"[^\W\d_]"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%-]*{_AT}[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.I)
_SPELLED = re.compile(rf"(?<![\w.+%-])(?=[\w.+%-]*[\d._+-])[\w][\w.+%-]*\sat\s[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+", re.I)
_LAST_LABEL = re.compile(r"[a-z]{2,}$", re.I)

_SEP = r"[ .\-–‑/  ]"
_NUMBER = re.compile(rf"(?<![\w#])(?<!\d[.,:/\-–‑])[+(]{{0,2}}\d(?:[()]|{_SEP}|\d)*\d(?![\w]|[.,:\-–‑/]\d)")
# Fixed formats: how phone numbers are grouped, after every separator became a blank; brackets dropped.
_PHONE_SHAPES = re.compile(
    r"\+\d{8,15}|\+\d{1,3}(?: \d{1,5}){2,6}|00[1-9]\d{0,2}(?: \d{2,5}){2,5}|00[1-9]\d{9,12}|(?:1 )?[2-9]\d{2} \d{3} \d{4}|[2-9]\d{2} \d{4}|[2-9]\d{9}|0\d{9,10}"
    r"|0\d{2,4} \d{6,8}|0\d{2,4} \d{3,4} \d{3,4}|0[1-9](?: \d{2}){4}|[679]\d{2}(?: \d{2}){3}|[679]\d{2} \d{3} \d{3}"
)
_ID_CUE = re.compile(
    r"(?<!\w)(?:ssn|social security(?: (?:no|number|nr))?|ni(?:no)?(?: (?:number|no))?|national insurance(?: (?:number|no))?|dni|nie|nif|pass(?:port)?(?: (?:no|number|nr))?"
    r"|reisepass|passeport|pasaporte|steuer-?id(?:nr)?|steueridentifikationsnummer|personalausweis|ausweis|driv(?:er|ing)(?:'s)? licen[cs]e|tax id|id card|identity card"
    r"|numéro de sécurité sociale|sécu|insee)(?:\s?(?:no|nr|number|nº|n°))?[.:#]?\s{0,2}(?=[a-z]{0,3}[ -]?\d)",
    re.I,
)
_ID_VALUE = re.compile(r"[A-Za-z]{0,3}[ -]?\d(?:[ .\-–/]?\d)*(?:[ -]?[A-Za-z](?![A-Za-z]))?")
_ID_BARE = re.compile(r"(?<![\w\-–.])(?:\d{3}[-–‑]\d{2}[-–‑]\d{4}(?![\w]|[-–‑.]\w)|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)|\d{8}-?[A-Z](?!\w)|[XYZ]-?\d{7}-?[A-Z](?!\w)|\d{2} \d{3} \d{3} \d{3}(?![\w ]\d))")
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# Words that begin no street name.
_NO_STREET = "to|of|on|in|at|the|and|for|items|boxes|minutes|hours|percent|files|notes|warnings|steps|entries|january|february|march|april|may|june|july|august|september|october|november|december|januar|februar|märz|mai|juni|juli|oktober|dezember"
_W = rf"(?:(?!(?:{_NO_STREET})(?!\w)){_LETTER}[\w'’-]*)"
_EN = r"street|st|road|rd|lane|ln|row|close|avenue|ave|way|drive|dr|court|ct|place|pl|square|sq|terrace|gardens|crescent|mews|boulevard|blvd|walk|parade|grove|hill|parkway|pkwy|highway|hwy|circle|trail|turnpike"
_ADDRESS = (
    re.compile(rf"(?<![\w.\-–/:#])\d{{1,6}}[a-z]?,? (?:[NSEW]\.?(?:[NSEW]\.?)? )?(?:(?:St\.|{_W}) ){{1,3}}?(?:{_EN})(?!\w)", re.I),
    re.compile(r"(?<!\w)(?:p\.? ?o\.? ?box|postfach|apartado(?: de correos)?|apdo\.?|b\.? ?p\.?|boîte postale|casilla)(?: no\.?| n[º°]\.?)? ?\d[\d ]*", re.I),
    re.compile(rf"(?<!\w)(?:{_W} ){{0,2}}?{_LETTER}*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|damm|steig|chaussee) \d{{1,4}} ?(?:[a-z](?!\w))?", re.I),
    re.compile(r"(?<![\w.\-–/:#])\d{1,4}(?: ?(?:bis|ter|quater)| ?[a-d])?,? (?:rue|avenue|av\.|chemin|quai|impasse|place|boulevard|bd|allée|route|cours|passage|square|sentier) ", re.I),
    re.compile(rf"(?<![\w])(?:calle|c/|plaza|pza\.|paseo|avenida|avda?\.|camino|carrer|ronda|travesía|cuesta|glorieta) ?(?:(?:de|del|la|las|los|el|{_W}) ?){{1,5}},? ?(?:n[º°.]+ ?|número )?\d{{1,4}}", re.I),
    re.compile(rf"(?<!\w)(?:am|an der|auf der|auf dem|im|in der|hinter der|unter den|zum|zur) (?:{_W} ){{1,2}}\d{{1,4}} ?[a-z]?(?=, ?(?:\d{{4,5}} )?{_LETTER})", re.I),
)
#: Words that an address of each pattern holds, whose ends are word ends except before a stop, and how many words before
#: the one that holds such a word the address may begin.
_ADDRESS_CUES = (
    [f" {w}" for w in _EN.split("|")],
    "box postfach apartado apdo b.p. bp correos casilla postale".split(),
    "straße strasse str. weg gasse allee platz ring ufer damm steig chaussee".split(),
    [f" {w}" for w in "rue avenue av. chemin quai impasse place boulevard bd allée route cours passage square sentier".split()],
    "calle c/ plaza pza. paseo avenida avd avda camino carrer ronda travesía cuesta glorieta".split(),
    "am der dem im den zum zur".split(),
)
_ADDRESS_WORDS = (6, 2, 2, 3, 0, 1)
_ID_CUES = ("ssn", "social security", "ni", "national insurance", "dni", "nie", "nif", "pass", "reisepass", "pasaporte", "steuer", "personalausweis", "ausweis", "driv", "tax id", "id card", "identity card", "numéro de sécu", "sécu", "insee")
_AT_CUES = ("@", "(at", "[at", "{at", "( at", "[ at", "{ at", " at ")
_SCHEMES = ("tel:", "callto:", "sms:")

#: Words beside a name that make a lone word a name.
_BEFORE = re.compile(r"(?:\b(?:ask|asked|told|met|with|avec|con|mit|call|called|contact|did|put|thank|und|et|place|goes to|rückfragen|contacto?)(?: ?:)?|:) $", re.I)
_AFTER = re.compile(r"(?:'s |’s | (?:told|left|wants?|says?|said|and|et|und|y|is coming|are coming|kommen|kommt|reply|replied|about|down for|hat|dejó|a laissé|called|asked|met|<|\()|,? (?:\+|\(|\d)|, ?[\w.+-]+ ?@| \()", re.I)
# Words directly before or after a person, told by their automaton; a capital run beside them is a name.
_CUES_BEFORE = (" met ", "lunch with ", "dinner with ", "déjeuner avec ", "comida con ", "mittagessen mit ", "ask ", "put ", "did ", "a place: ", "rückfragen: ", "contact : ", "contacto: ", "goes to ")
_CUES_AFTER = (" told me ", " left a ", " left the ", " reply about ", " replied ", " are coming ", " is coming ", " kommen um ", " hat der ", " hat die ", " hat das ", " dejó ", " a laissé ", " wants to ", " called me ")
_NO_NAME = frozenset("monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december the a an this that it he she they we you i who what somebody someone nobody everybody and but or my our his her their".split())
_RUN = rf"(?:{_LETTER}\.\s)?{_LETTER}[\w'-]+(?:\s{_LETTER}\.)?(?:\s(?:(?:de|del|van|von|di)\s)?{_LETTER}[\w'-]+)?"
_RUN_AFTER = re.compile(_RUN)
_RUN_BEFORE = re.compile(rf"(?<![\w.@])({_RUN})(?:\s\([^)]*\)+)?$")
_PART = re.compile(rf"{_LETTER}[\w'’-]*")
_INITIAL = re.compile(rf"(?<!\w){_LETTER}\.\s?$")
_INITIAL_NEXT = re.compile(rf"{_LETTER}\.\s?")
_FAMILY_NEXT = re.compile(rf" (?:{_LETTER}\. ?)?({_LETTER}[\w'’-]+)")
_REST = re.compile(rf"\s+(?:({_LETTER})\.\s?)?({_LETTER}[\w'’-]*)|\s({_LETTER})\.")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(parts: dict[str, str], anchors: bool = True) -> ahocorasick.Automaton:
    """Automaton of name parts (G given, F family, B both) and, if wanted, all other anchors: (kinds, length) at each end."""
    found = dict(parts)

    def add(words, kind: str) -> None:
        for word in words:
            found[word] = found.get(word, "") + kind

    if anchors:
        add(_AT_CUES, "@")
        for n, group in enumerate(_ADDRESS_CUES):
            add(group, str(n))
        add(_ID_CUES, "I")
        add(_SCHEMES, "S")
        add("0123456789", "D")
        add(_CUES_BEFORE, "<")
        add(_CUES_AFTER, ">")
        add((f"{title}{stop} " for title in TITLES for stop in ("", ".")), "T")
    machine = ahocorasick.Automaton()
    for word, kinds in found.items():
        machine.add_word(word, (kinds, len(word)))
    machine.make_automaton()
    return machine


def anchors_in(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the anchors in a text; of digits only the first of a run, of words only whole ones."""
    low, out = _lower(text), []
    size = len(low)
    for end, (kinds, length) in machine.iter(low):
        stop, start = end + 1, end + 1 - length
        free_before = not start or not (low[start - 1].isalnum() or low[start - 1] in "_@")
        free_behind = stop == size or not (low[stop].isalnum() or low[stop] in "_@")
        for kind in kinds:
            if kind == "D":
                keep = not start or not low[start - 1].isdigit()
            elif kind in "GFB":
                keep = free_before and free_behind
            elif kind == "T":
                keep = free_before
            elif kind == "<":
                keep = not low[start].isalnum() or not start or not low[start - 1].isalnum()
            elif kind in "0123456":
                keep = stop == size or not low[stop].isalnum() or low[end] == "/"
            else:
                keep = True
            if keep:
                out.append((start, stop, kind))
    return out


class Taken:
    """Parts of a text that items have, none overlapping another."""

    def __init__(self):
        self.parts: list[tuple[int, int]] = []

    def free(self, start: int, stop: int) -> bool:
        at = bisect(self.parts, (start, stop))
        return (not at or self.parts[at - 1][1] <= start) and (at == len(self.parts) or stop <= self.parts[at][0])

    def add(self, items: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Those of the items that are free, which are taken now."""
        kept = [x for x in items if self.free(*x[1:])]
        for _, a, b in kept:
            insort(self.parts, (a, b))
        return kept


def _clear(items: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without those that overlap an earlier one, from left to right."""
    out: list[tuple[str, int, int]] = []
    for x in sorted(set(items), key=lambda x: (x[1], -x[2])):
        if not out or x[1] >= out[-1][2]:
            out.append(x)
    return out


def _email_at(text: str, start: int) -> tuple[str, int, int] | None:
    """The address around an at-sign or a word for it: back over the local part, then forward."""
    at = start
    while at and (text[at - 1].isspace() or text[at - 1] in "([{") and start - at < 2:
        at -= 1
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.+%-"):
        at -= 1
    while at < start and not (text[at].isalnum() or text[at] == "_"):
        at += 1
    for pattern in (EMAIL, _SPELLED):
        m = pattern.match(text, at)
        if m and m.end() > start:
            last = _LAST_LABEL.search(m.group())
            if last and last.group().lower() not in FILE_ENDINGS:
                return "email", m.start(), m.end()
    return None


def _cued_id(text: str, start: int) -> tuple[str, int, int] | None:
    """The number behind the words for an identity number."""
    m = _ID_CUE.match(text, start)
    v = _ID_VALUE.match(text, m.end()) if m else None
    return ("id_number", v.start(), v.end()) if v and sum(c.isdigit() for c in v.group()) >= 6 else None


def _bare_id(text: str, start: int) -> tuple[str, int, int] | None:
    """An identity number known by its form, from its first digit and at most two letters, a blank or a dash before it."""
    for first in range(max(0, start - 3), start + 1):
        m = _ID_BARE.match(text, first)
        if m and m.end() > start:
            s = m.group().replace("-", "")
            if s[:8].isdigit() and len(s) == 9 and s[8].isalpha() and _DNI_LETTERS[int(s[:8]) % 23] != s[8]:
                continue
            return "id_number", m.start(), m.end()
    return None


def _phone_at(text: str, start: int, sure: bool = False) -> tuple[tuple[str, int, int] | None, int]:
    """The phone number from its first digit and the marks before it, and how far the digits and marks go. One that is
    ``sure``, behind a scheme, may be grouped in any way."""
    first = start
    while first and text[first - 1] in "+(" and start - first < 2:
        first -= 1
    m = next((m for f in range(first, start + 1) if (m := _NUMBER.match(text, f))), None)
    if not m:
        return None, start
    first, s = m.start(), m.group()
    while s and s[0] == "(" and s.count("(") > s.count(")"):
        first, s = first + 1, s[1:]
    shape = re.sub(r"[ .\-–‑/  ]+", " ", s.replace("(0)", " ").replace("(", " ").replace(")", " ")).strip()
    if re.search(r"\d\.\d", s) and s.count(".") != 2 + (shape[:2] == "1 ") and s[0] != "+":
        return None, m.end()
    fits = (sure or _PHONE_SHAPES.fullmatch(shape)) and 7 <= sum(c.isdigit() for c in s) <= 16
    return ("phone", first, m.end()) if fits else None, m.end()


def _word_starts(text: str, at: int, words: int) -> list[int]:
    """Where the word at a place and so many words before it begin, from left to right."""
    out = []
    while len(out) <= words:
        while at and not text[at - 1].isspace():
            at -= 1
        out.append(at)
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            break
    return out[::-1]


def _address_at(text: str, start: int, stop: int, n: int) -> tuple[str, int, int] | None:
    """The address that a word of pattern ``n`` belongs to, begun at one of the words before it or inside one of them."""
    pattern = _ADDRESS[n]
    for word in _word_starts(text, start + (text[start] == " "), _ADDRESS_WORDS[n]):
        for first in range(word, min(stop, word + 4) if word < start else stop):
            if first > word and (text[first - 1].isalnum() or text[first - 1] == "_"):
                continue
            m = pattern.match(text, first)
            if m and m.end() >= stop:
                begin = m.start()
                if n == 2:  # the words before a German street belong to it only if capital
                    parts = list(re.finditer(r"\S+", m.group()))
                    street = next(i for i, w in enumerate(parts) if w.group()[0].isdigit()) - 1
                    while street > 0 and parts[street - 1].group() in ("Am", "An", "Auf", "Im", "In", "Zur", "Zum", "der", "dem", "den", "Alte", "Alter", "Lange", "Neue", "Neuer", "Große", "Kleine", "Obere", "Untere"):
                        street -= 1
                    begin += parts[street].start()
                return "address", begin, m.end()
    return None


def _names(text: str, hits: list[tuple[int, int, str]], taken: Taken, agent: str) -> list[tuple[str, int, int]]:
    """Names from hits of name parts and titles, in order; a name starts at its first part or initial."""
    out: list[tuple[str, int, int]] = []
    done = 0
    family = {s for s, _, k in hits if k in "FB"}
    for start, end, kind in sorted(hits):
        if start < done or not taken.free(start, start + 1):
            continue
        if kind == "T":
            part = _PART.match(text, end)
            initial = _INITIAL_NEXT.match(text, end)
            if initial:
                part = _PART.match(text, initial.end())
            if part and part.group().lower() in TITLES:
                continue
            if not part or not (part.group()[0].isupper() and len(part.group()) > 1) or not text[start].isupper():
                continue
            first, stop = initial.start() if initial else part.start(), part.end()
            follow = _FAMILY_NEXT.match(text, stop)
            if follow and follow.group(1)[0].isupper() and follow.start(1) in family:
                stop = follow.end()
            out.append(("name", first, stop))
            done = stop
            continue
        word = text[start:end]
        if word.lower() == agent:
            continue
        stop, first = end, start
        paired = False
        if kind in "GB":
            nxt = _REST.match(text, end)
            if nxt and nxt.group(2):
                two = nxt.group(2)
                known = nxt.start(2) in family
                if known or (nxt.group(1) and two[0].isupper()):
                    stop, paired = nxt.end(2), True
                elif nxt.group(1) and nxt.group(1).isupper():
                    stop, paired = nxt.end(1) + 1, True
                elif word[0].isupper() and two[0].isupper() and len(two) > 3 and two.lower() not in _NO_NAME and _AFTER.match(text, nxt.end(2)):
                    stop, paired = nxt.end(2), True
            elif nxt and nxt.group(3) and nxt.group(3).isupper():
                stop, paired = nxt.end(3) + 1, True
        if not paired and kind in "FB":
            before = _INITIAL.search(text, max(0, start - 4), start)
            if before and text[before.start()].isupper():
                first, paired = before.start(), True
        if not paired:
            if not word[0].isupper():
                continue
            if kind in "GB" and word.lower() in WORDY:
                before, after = text[max(0, start - 24) : start], text[end : end + 24]
                if not (_BEFORE.search(before) or _AFTER.match(after)) or re.match(r" (?:the|is|an|a(?! laissé))\b", after):
                    continue
                if word.lower() in ("may", "june", "april", "august") and re.search(r"(?:\d|\b(?:in|of|until|since|by|from|to|and|for)) $", before):
                    continue
        out.append(("name", first, stop))
        done = stop
    return out


def _beside(text: str, cue: tuple[int, int, str], known: list[tuple[int, int, str]]) -> tuple[str, int, int] | None:
    """The name beside a cue: a run of capital words, or of small ones that begins with a known given name."""
    start, stop, side = cue
    m = _RUN_AFTER.match(text, stop) if side == "<" else _RUN_BEFORE.search(text, max(0, start - 60), start)
    if not m:
        return None
    a, b = (m.start(), m.end()) if side == "<" else m.span(1)
    words = [(w.start() + a, w.group()) for w in re.finditer(r"\S+", text[a:b])]
    if side == ">" and len(words) > 1 and not words[0][1][0].isupper() and not any(s == a and k in "GB" for s, _, k in known):
        words = words[1:]
    small = lambda w: not w[1][0].isupper()
    if small(words[0]) and not any(s == words[0][0] and k in "GB" and text[s:e].lower() not in WORDY for s, e, k in known):
        return None
    if any(w.lower().rstrip(".") in _NO_NAME or w.lower().rstrip(".") in TITLES for _, w in words[:1]):
        return None
    end = words[0][0] + len(words[0][1])
    for at, w in words[1:]:
        if small(words[0]) or w[0].isupper():
            end = at + len(w)
    return "name", words[0][0], end


def items_at(text: str, anchors: list[tuple[int, int, str]], agent: str = "tessel") -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items at the anchors of a text, in order, none overlapping another of an earlier kind."""
    by_kind: dict[str, list[tuple[int, int, str]]] = {}
    for x in sorted(set(anchors)):
        by_kind.setdefault(x[2], []).append(x)
    get = lambda kinds: [x for k in kinds for x in by_kind.get(k, ())]
    taken = Taken()
    out = taken.add(_clear([x for a, _, _ in get("@") if (x := _email_at(text, a))]))
    digits = get("D")
    if digits:
        ids = _clear([x for a, _, _ in get("I") if (x := _cued_id(text, a))])
        out += taken.add(ids)
        out += taken.add(_clear([x for a, _, _ in digits if (x := _bare_id(text, a))]))
        for n in (1, 0, 2, 3, 4, 5):  # a box before the street behind it
            out += taken.add(_clear([x for a, b, _ in get(str(n)) if (x := _address_at(text, a, b, n))]))
        phones, read = [], 0
        schemes = {b for _, b, _ in get("S")}
        for a, _, _ in digits:
            if a >= read:
                x, read = _phone_at(text, a, a in schemes or (a - 1 in schemes and text[a - 1] == "+"))
                phones += [x] if x else []
        out += taken.add(phones)
    parts = get("GFBT")
    if parts:
        longest: dict[int, tuple[int, int, str]] = {}
        for x in parts:
            if x[0] not in longest or longest[x[0]][1] < x[1]:
                longest[x[0]] = x
        out += taken.add(_names(text, list(longest.values()), taken, agent))
    for cue in sorted(get("<>"), key=lambda x: (x[1], x[0])):
        x = _beside(text, cue, parts if len(parts) < 50 else [p for p in parts if abs(p[0] - cue[0]) < 300])
        if x and text[x[1] : x[2]].lower() != agent:
            out += taken.add([x])
    return sorted(out, key=lambda x: x[1])


def find_items(text: str, machine: ahocorasick.Automaton, agent: str = "tessel") -> list[tuple[str, int, int]]:
    return items_at(text, anchors_in(text, machine), agent)


def name_parts(entities: DataFrame) -> DataFrame:
    """Given and family names (lower case) that the people in ``entities`` have: columns part, role (G or F).

    A given name starts at least two names of type person with different family names; a family name follows one.
    """
    bare = F.regexp_replace(F.trim(F.lower(F.col("name"))), rf"^(?:{'|'.join(TITLES)})\.?\s+", "")
    bare = F.regexp_replace(bare, r"['’]s$|\s+\p{L}\.(?=\s)", "")
    words = entities.withColumn("w", F.split(F.regexp_replace(bare, r"\s+", " "), " "))
    pairs = words.where((F.size("w") == 2) & F.get("w", F.lit(0)).rlike(r"^\p{L}[\p{L}'’-]+$") & F.get("w", F.lit(1)).rlike(r"^\p{L}[\p{L}'’-]{2,}$"))
    pairs = pairs.select(F.get("w", F.lit(0)).alias("g"), F.get("w", F.lit(1)).alias("f"), "type").distinct()
    given = pairs.where("type = 'person'").groupBy("g").agg(F.countDistinct("f").alias("n"), F.count_if(F.length("f") > 3).alias("m")).where("n >= 2")
    family = pairs.join(given, "g", "left_semi").groupBy("f").agg(F.countDistinct("g").alias("n"))
    return given.select(F.col("g").alias("part"), F.lit("G").alias("role")).union(family.select("f", F.lit("F")))


def _pairs(given: list[str]):
    """Reads texts; gives each capital word that follows a given name, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for word in given:
            if word not in WORDY:
                machine.add_word(f"{word} ", len(word) + 1)
        machine.make_automaton()
        follow = re.compile(rf"(?:{_LETTER}\. )?({_LETTER}[\w’'-]{{3,}})")
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist() if len(machine) else ():
                low = _lower(text)
                for end, length in machine.iter(low):
                    start = end + 1 - length
                    if start and low[start - 1].isalnum() or not text[start].isupper():
                        continue
                    m = follow.match(text, end + 1)
                    if m and m.group(1)[0].isupper():
                        found.add(re.sub(r"['’]s$", "", m.group(1).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["part"])

    return run


def _blocks(names: DataFrame, size: int) -> Iterator[list]:
    """The rows of ``names`` (part, ...) in blocks of about ``size``, one at a time; without rows one empty block."""
    names = cut(names)
    n = max(1, -(-names.count() // size))
    block = F.pmod(F.xxhash64("part"), F.lit(n))
    for i in range(n):
        yield names.where(block == i).collect()  # about size rows


def all_name_parts(entities: DataFrame, rows: DataFrame, size: int = PASS_NAMES) -> DataFrame:
    """Name parts: part, role (G given, F family, B both).

    Given names: those of ``entities`` and the fixed ones. Family names: those of ``entities`` and the capital words
    that follow a given name somewhere in ``rows``.
    """
    spark = rows.sparkSession
    known = cut(name_parts(entities).union(spark.createDataFrame([(w, "G") for w in GIVEN], "part string, role string")).distinct())
    given = known.where("role = 'G'").select("part")
    family = known.where("role = 'F'").select("part")
    for block in _blocks(given, size):
        read = rows.select("text").mapInArrow(_pairs([x.part for x in block]), "part string")
        family = family.union(cut(read.distinct()))
    family = family.join(given, "part", "left_anti").distinct()
    both = known.groupBy("part").agg(F.max("role").alias("most"), F.min("role").alias("least"))
    roles = both.where("least = 'G' or most = 'G'").join(known.where("role = 'F'").select("part", F.lit(True).alias("f")), "part", "left")
    return cut(roles.select("part", F.when(F.col("f"), "B").otherwise("G").alias("role")).union(family.select("part", F.lit("F"))))


_ITEMS = "source_table string, row_id string, kind string, start_pos bigint, end_pos bigint"
_KEYS = ["source_table", "row_id"]


def found_items(rows: DataFrame, names: DataFrame, size: int = PASS_NAMES) -> DataFrame:
    """Per row of ``rows`` (source_table, row_id, text): source_table, row_id, text, items (an array of kind, start, stop).

    ``names``: part, role. If they are more than ``size``, the anchors are looked for in one pass over the texts for each block
    of them, written, and brought together by row before they are parsed; the driver and a worker hold one block only.
    Null texts have no items. Rows of one id count once.
    """
    item = "array<struct<kind: string, start: bigint, stop: bigint>>"
    blocks = list(itertools.islice(_blocks(names, size), 2))
    if len(blocks) == 1:
        parts = {x.part: x.role for x in blocks[0]}

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(parts)
            for batch in batches:
                found = [find_items(x, machine) if x else [] for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _array(found, _ITEM)], ["source_table", "row_id", "text", "items"])

        return rows.mapInArrow(whole, f"source_table string, row_id string, text string, items {item}")

    anchored = None
    for n, block in enumerate(_blocks(names, size)):
        parts = {x.part: x.role for x in block}

        def look(batches: Iterator[pa.RecordBatch], parts: dict = parts, n: int = n) -> Iterator[pa.RecordBatch]:
            machine = automaton(parts, anchors=n == 0)
            for batch in batches:
                found = [[(k, a, b) for a, b, k in anchors_in(x, machine)] if x and len(machine) else [] for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _array(found, _ITEM)], ["source_table", "row_id", "anchors"])

        hits = cut(rows.mapInArrow(look, f"source_table string, row_id string, anchors {item}").where("size(anchors) > 0"))
        anchored = hits if anchored is None else anchored.union(hits)
    anchored = anchored.groupBy(*_KEYS).agg(F.flatten(F.collect_list("anchors")).alias("anchors"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, anchors = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [items_at(x, [(h["start"], h["stop"], h["kind"]) for h in hs or []]) if x else [] for x, hs in zip(texts_, anchors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _array(found, _ITEM)], ["source_table", "row_id", "text", "items"])

    joined = rows.join(anchored, _KEYS, "left").select(*_KEYS, "text", "anchors")
    return joined.mapInArrow(parse, f"source_table string, row_id string, text string, items {item}")


_ITEM = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _array(found: list[list[tuple]], kind: pa.DataType) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    flat = [x for row in found for x in row]
    columns = list(zip(*flat, strict=True)) or [()] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, found))], pa.int32()), values)


def scan(rows: DataFrame, names: DataFrame, size: int = PASS_NAMES) -> DataFrame:
    """Items of ``rows`` (source_table, row_id, text): source_table, row_id, kind, start_pos, end_pos. The place is that of
    the first letter or digit. Null and empty texts have none. Rows of one id count once."""
    found = found_items(rows, names, size).where("size(items) > 0").select(*_KEYS, "text", F.inline("items"))
    lead = F.length(F.regexp_extract(F.expr("substring(text, start + 1, stop - start)"), r"^[^\p{L}\p{N}]*", 0))
    placed = found.select(*_KEYS, "kind", (F.col("start") + lead).cast("bigint").alias("start_pos"), "stop")
    return placed.groupBy(*_KEYS, "kind", "start_pos").agg(F.max("stop").alias("end_pos"))


def texts(windows: DataFrame, actions: DataFrame) -> DataFrame:
    both = windows.select(F.lit("windows").alias("source_table"), F.col("id").alias("row_id"), "text")
    return both.union(actions.select(F.lit("actions"), "id", "request_text")).where("text is not null")


def redacted(rows: DataFrame, names: DataFrame, size: int = PASS_NAMES) -> DataFrame:
    """``rows`` with each item in ``text`` replaced by a placeholder of its kind, such as [EMAIL]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces, at = [], 0
                for x in sorted(items or [], key=lambda x: (x["start"], -x["stop"])):
                    if x["start"] >= at:
                        pieces += [text[at : x["start"]], f"[{x['kind'].upper()}]"]
                        at = x["stop"]
                out.append(text if not items else "".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["source_table", "row_id", "text"])

    return found_items(rows, names, size).mapInArrow(run, "source_table string, row_id string, text string")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = texts(table(spark, sf_dir, "windows"), table(spark, sf_dir, "actions"))
    return rows, all_name_parts(table(spark, sf_dir, "entities"), rows)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(*_inputs(spark, sf_dir)).drop("end_pos")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(*_inputs(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict[str, str] = {}
