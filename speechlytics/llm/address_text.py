"""From an address as somebody wrote or heard it to its parts, without knowing any place name."""

from __future__ import annotations

import re
from typing import NamedTuple

# Street types with the ways they are abbreviated.
STREET_TYPES = {
    "alley": "aly",
    "arcade": "arc",
    "avenue": "ave av aven avn",
    "boulevard": "blvd bvd boul bvde blv",
    "circle": "cir",
    "circuit": "cct circ",
    "close": "cl clo cls",
    "court": "ct crt cour",
    "crescent": "cres crs cr crescen crst",
    "drive": "dr drv dve drv",
    "esplanade": "esp espl",
    "gardens": "gdns gdn",
    "grove": "gr gve grv",
    "highway": "hwy",
    "lane": "ln la lne",
    "loop": "lp",
    "mews": "mws",
    "parade": "pde par prd pda",
    "place": "pl plc plce",
    "road": "rd rod",
    "square": "sq",
    "street": "st str stre",
    "terrace": "tce ter terr trc",
    "track": "trk",
    "walk": "wlk wk",
    "way": "wy",
}
# States with their spoken names.
STATES = {
    "nsw": "new south wales",
    "vic": "victoria",
    "qld": "queensland",
    "wa": "western australia",
    "sa": "south australia",
    "tas": "tasmania",
    "nt": "northern territory",
    "act": "australian capital territory",
}
# Words before and after a locality's name, with their abbreviations.
AFFIXES = {
    "north": "nth",
    "south": "sth",
    "east": "est",
    "west": "wst",
    "saint": "st snt",
    "mount": "mt mnt",
    "port": "pt prt",
    "lake": "lk lke",
    "upper": "upr",
    "lower": "lwr",
    "point": "pnt",
    "heights": "hts hgts ht",
    "creek": "ck crk",
    "park": "pk prk",
    "beach": "bch",
    "valley": "vly",
    "hill": "hl",
    "hills": "hls",
    "springs": "spgs",
    "junction": "jn jct",
}
FRONT = {"north", "south", "east", "west", "saint", "mount", "port", "lake", "upper", "lower", "point"}

_TYPE = {a: t for t, short in STREET_TYPES.items() for a in (t, *short.split())}
_AFFIX = {a: w for w, short in AFFIXES.items() for a in (w, *short.split())}
_UNIT = {"unit", "flat", "apartment", "apt", "u", "suite", "villa", "fl"}
_NUMBER = {"number", "no", "num", "nr"}
_NOISE = set(
    "uh um so okay ok yeah yes well er ah thanks thank you please my our the address is are i live at we re were it s its"
    " in that this and of a an postcode post code street_is here now current home".split()
)
_DIGITS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": 0, "o": 0, "nought": 0}
_TEENS = {
    w: k + 10
    for k, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())
}
_TENS = {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"fourty": 40}
_SPELT = re.compile(
    r"\b(?:" + "|".join(
        [r"[.\s]*".join(s) for s in STATES] + [n.replace(" ", r"\s+") for n in STATES.values()]
    ) + r")\b\.?"
)
_STATE_OF = {n.replace(" ", ""): s for s, n in STATES.items()} | {s: s for s in STATES}
_RANGE = re.compile(r"(\d+[a-h]?)\s*[-\u2013\u2014]\s*(\d+[a-h]?)\b")
_TOKEN = re.compile(r"\d+[a-h]?~\d+[a-h]?|[a-z]+|\d+|[/,;#]|§")


class Parts(NamedTuple):
    """What one mention says; names are lower case without spaces, None where nothing is said."""

    unit: str | None = None
    number: str | None = None
    street: str | None = None
    type: str | None = None
    suburb: str | None = None
    state: str | None = None
    postcode: str | None = None


def _spoken(tokens: list[str]) -> list[str]:
    """Number words to digits; digits spoken one by one (three or more) are joined."""
    out: list[str] = []
    k = 0
    while k < len(tokens):
        run = k
        while run < len(tokens) and tokens[run] in _DIGITS and not (tokens[run] in ("o",) and run == k):
            run += 1
        if run - k >= 3 and not (run < len(tokens) and tokens[run] == "hundred"):
            out.append("".join(str(_DIGITS[t]) for t in tokens[k:run]))
            k = run
            continue
        t = tokens[k]
        value, at = None, k
        if t in _DIGITS and t != "o":
            value, at = _DIGITS[t], k + 1
            if at < len(tokens) and tokens[at] == "hundred":
                value, at = value * 100, at + 1
                more = at + 1 if at < len(tokens) and tokens[at] == "and" else at
                tail, after = _below_hundred(tokens, more)
                if tail is not None:
                    value, at = value + tail, after
        elif t in _TENS or t in _TEENS:
            value, at = _below_hundred(tokens, k)
        if value is None:
            out.append(t)
            k += 1
        else:
            out.append(str(value))
            k = at
    return out


def _below_hundred(tokens: list[str], k: int) -> tuple[int | None, int]:
    if k >= len(tokens):
        return None, k
    t = tokens[k]
    if t in _TENS:
        if k + 1 < len(tokens) and 0 < _DIGITS.get(tokens[k + 1], 0):
            return _TENS[t] + _DIGITS[tokens[k + 1]], k + 2
        return _TENS[t], k + 1
    if t in _TEENS:
        return _TEENS[t], k + 1
    if t in _DIGITS and t != "o":
        return _DIGITS[t], k + 1
    return None, k


def _tokens(text: str) -> tuple[list[str], str | None]:
    text = text.lower().replace("’", "'")
    state = None

    def found(m: re.Match) -> str:
        nonlocal state
        state = _STATE_OF[re.sub(r"[^a-z]", "", m[0])]
        return " , "

    text = _SPELT.sub(found, text)
    text = re.sub(r"\bthe street is\b", " , § ", text)
    text = _RANGE.sub(r"\1~\2", re.sub(r"\bslash\b", "/", text))
    text = re.sub(r"\b(?:that is in|postcode|number|in)\b", r" , \g<0> ", text)
    return _ranges(_spoken(_TOKEN.findall(text.replace("'", "")))), state


def _ranges(tokens: list[str]) -> list[str]:
    """"12 to 14" and "12~14" to one token "12-14"."""
    out: list[str] = []
    for k, t in enumerate(tokens):
        if t.isdigit() and len(out) > 1 and out[-1] == "to" and out[-2].isdigit():
            out[-2:] = [f"{out[-2]}-{t}"]
        else:
            out.append(t.replace("~", "-"))
    return out


def _is_house(tokens: list[str], k: int, words_before: bool) -> bool:
    """Whether the four digits at ``k`` are a house number: they lead a street's name, and no other number follows it."""
    rest = tokens[k + 1 :]
    stop = next((j for j, t in enumerate(rest) if t in ",;§"), len(rest))
    piece = rest[:stop]
    typed = next((j for j, t in enumerate(piece) if j and t in _TYPE), None)
    if words_before or typed is None or not piece[0].isalpha() or piece[0] in _NOISE:
        return False
    return not any(t.isdigit() and len(t) < 4 for t in piece[typed:])


def street_name(words: list[str]) -> str | None:
    """A street's name of one or more words, without spaces; of several, affixes are written out."""
    return "".join(words) or None if len(words) < 2 else squeeze(words)


def squeeze(words: list[str]) -> str | None:
    """A locality's name with its affixes written out and no spaces."""
    return "".join(_AFFIX.get(w, w) for w in words) or None


def parse_text(text: str | None) -> Parts:
    """The parts of an address in running text; any part may be missing, and the order is free."""
    if not text or not text.strip():
        return Parts()
    tokens, state = _tokens(text)
    unit = number = street = kind = postcode = None
    numbers: list[tuple[int, str]] = []
    pieces: list[list] = [[]]  # by comma: words, with street types marked
    k, expect_unit, ahead = 0, False, None
    street_next, said = False, ""
    while k < len(tokens):
        t = tokens[k]
        after = tokens[k + 1] if k + 1 < len(tokens) else ""
        if t in (",", ";", "§"):
            pieces.append([])
            street_next = street_next or t == "§"
            if t == "§":
                pieces[-1].append(("street", ""))
        elif t == "/":
            if numbers and after.isdigit():
                unit = numbers.pop()[1]
        elif t == "#":
            pass
        elif t in _UNIT and (after.isdigit() or after == ","):
            expect_unit = True
        elif t.isdigit():
            letter = ""
            if len(after) == 1 and "a" <= after <= "h" and (len(t) < 4):
                letter, k = after, k + 1
            if expect_unit and unit is None:
                unit, expect_unit = t + letter, False
            elif len(t) == 4 and not letter and not _is_house(tokens, k, any(kd == "word" for kd, _ in pieces[-1])):
                postcode = t
            else:
                numbers.append((len(pieces), t + letter))
                pieces[-1].append(("number", t + letter))
        elif t[0].isdigit():  # a range
            numbers.append((len(pieces), t))
            pieces[-1].append(("number", t))
        elif t in _TYPE and pieces[-1] and pieces[-1][-1][0] == "type" and len(pieces[-1]) > 1:
            pieces[-1][-1] = ("word", said)  # "Kings Court Road": the last one is the type
            pieces[-1].append(("type", _TYPE[t]))
            said = t
        elif t in _NUMBER and (after.isdigit() or after in (",", "#") or after in _UNIT):
            pass
        elif t in _TYPE and pieces[-1] and pieces[-1][-1][0] == "word" and not (
            t in ("st",) and pieces[-1][-1][1] in FRONT
        ):
            pieces[-1].append(("type", _TYPE[t]))
            said = t
        elif t in _NOISE:
            pass
        elif len(t) == 1 and t not in "/":
            pass
        else:
            pieces[-1].append(("word", t))
        k += 1
    if numbers:
        number = numbers[0][1] if unit is not None or len(numbers) == 1 else numbers[-1][1]
        if unit is None and len(numbers) > 1:
            unit = numbers[0][1]
    # The words before a street type are the street; those right after the number, if no type is said.
    suburb_words: list[str] = []
    for piece in pieces:
        words: list[str] = []
        after_number = False
        typed = any(kd == "type" for kd, _ in piece)
        for kd, value in piece:
            if kd == "number":
                after_number = True
                if words:
                    suburb_words = suburb_words or words
                    words = []
            elif kd == "street":
                after_number = True
            elif kd == "word":
                words.append(value)
            elif kd == "type" and words:
                if street is None:
                    street, kind = street_name(words), value
                words = []
                after_number = False
        if words:
            if after_number and not typed and street is None:
                street = words[0]
                if len(words) > 1 and not suburb_words:
                    suburb_words = words[1:]
            elif not suburb_words:
                suburb_words = words
    return Parts(unit, number, street, kind, squeeze(suburb_words), state, postcode)


def _plain(text: str | None) -> str:
    return (text or "").strip()


def parse_fields(fields: dict | None) -> Parts:
    """The parts of a structured address whose fields may be merged, swapped, abbreviated or missing."""
    if not fields:
        return Parts()
    get = lambda k: _plain(fields.get(k))
    unit, number, street, kind, suburb, state, postcode = map(get, Parts._fields)
    lead = f"unit {unit}, {number}" if unit else number
    whole = street if re.search(r"\d|,", street) else ""
    if whole:  # everything merged into one field
        return parse_text(", ".join(x for x in (lead, whole, suburb, state, postcode) if x))
    words = _spoken(_TOKEN.findall(suburb.lower()))
    last = words[-1] if words else ""
    if not kind and last in _TYPE and len(words) > 1:  # street and suburb are swapped
        street, kind, suburb = " ".join(words[:-1]), last, street
    else:
        of_street = _TOKEN.findall(street.lower())
        if not kind and len(of_street) > 1 and of_street[-1] in _TYPE:
            street, kind = " ".join(of_street[:-1]), of_street[-1]
    n = parse_text(f"{lead} xqx street") if lead else Parts()
    s = parse_text(f"1 xqx street, {suburb}, {state} {postcode}")
    street_words = [w for w in _TOKEN.findall(street.lower()) if w.isalpha()]
    name = street_name(street_words)
    marks = _TOKEN.findall(kind.lower())
    return Parts(n.unit, n.number, name or None, _TYPE.get(marks[0]) if marks else None, s.suburb, s.state, s.postcode)
