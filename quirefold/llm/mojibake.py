"""Text decoded with the wrong encoding: best-first search for the cheapest reachable text.

States are texts.  From a state lead operations: take the characters as bytes of one encoding and read them in another,
over the stretches where that is possible, or read numeric references.  Every state has a cost that tells how implausible
its characters are, alone and beside each other; the search always expands the cheapest state not yet visited
(visited states are kept as hashes) and stops at a state that nothing asks to read otherwise, or when nothing is left.
States dearer by ``slack`` than the one they come from are not followed; there is no limit on their number or depth.

Readings as UTF-8 shorten a text, so from one state there are finitely many.  Pairs of other encodings lead back and forth
between ever new texts: they are followed only from states at most ``tail`` dearer than the cheapest text found.  Where that
text holds next to nothing suspicious, dearer states are not followed at all.

Costs add up over the parts between spaces, so they are kept by part: the words of a language cost one walk each.

A value is reported when the cheapest text costs clearly less than the value itself (after its numeric references
are read), or when it holds characters that only a wrong decoding leaves: U+FFFD and C1 controls.  ``restored`` is null when
something was lost.  Null and blank values are not reported.  Named references for correct characters are left alone.
"""

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import spread

#: Encodings in which bytes of UTF-8 are often read.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp1254", "cp866", "iso8859_2", "cp1253", "cp1257", "mac_cyrillic"]
#: (read as, written in) of encodings other than UTF-8.
REREAD = [
    ("cp1252", "gb18030"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8_r"),
    ("cp1252", "cp932"),
    ("cp1252", "euc_jp"),
    ("cp1252", "euc_kr"),
    ("cp1252", "big5"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1254"),
    ("cp1252", "cp1258"),
    ("cp1252", "iso8859_5"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1251"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("mac_cyrillic", "cp1251"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("mac_roman", "cp1252"),
    ("koi8_r", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp1250", "cp1252"),
    ("gb18030", "utf_8"),
    ("cp932", "utf_8"),
    ("big5", "utf_8"),
    ("euc_kr", "utf_8"),
    ("gb18030", "cp932"),
    ("cp932", "gb18030"),
]

_NUMERIC = re.compile(r"&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
_RUN = re.compile(r"[^\x00-\x7f�]+")
_RUN_AND_ONE = re.compile(r"[^\x00-\x7f�]+[\x40-\x7e]?")
_MULTI_BYTE = ("gb18030", "cp932", "big5", "euc_kr", "euc_jp")
_state: dict = {}
_more: dict = {}


def _encodings() -> dict[str, tuple[dict[str, int], re.Pattern]]:
    """For each single-byte encoding: its characters' byte values, and the pattern of UTF-8 sequences read in it."""
    if not _state:
        for name in {*READ_AS, *(a for a, _ in REREAD if a not in _MULTI_BYTE)}:
            byte_of: dict[str, int] = {}
            for byte in range(0x80, 0x100):
                try:
                    char = bytes([byte]).decode(name)
                except UnicodeDecodeError:
                    char = chr(byte)
                byte_of[char] = byte
            for byte in range(0x80, 0x100 if name == "cp1252" else 0xA0):  # what a reader let through as it was
                byte_of.setdefault(chr(byte), byte)

            def some(lo: int, hi: int) -> str:
                return "[" + "".join(re.escape(c) for c, b in byte_of.items() if lo <= b <= hi) + "]"

            more = some(0x80, 0xBF)
            pattern = f"{some(0xC2, 0xDF)}{more}|{some(0xE0, 0xEF)}{more}{{2}}|{some(0xF0, 0xF4)}{more}{{3}}"
            _state[name] = byte_of, re.compile(pattern)
    return _state


def numeric_references_read(text: str) -> str:
    """``text`` with its numeric references replaced by their characters."""

    def char(m: re.Match) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _NUMERIC.sub(char, text) if "&#" in text else text


def _as_utf8(text: str, byte_of: dict[str, int], pattern: re.Pattern) -> str:
    """Stretches that are UTF-8 in the bytes of an encoding, decoded."""

    def read(m: re.Match) -> str:
        try:
            return bytes(map(byte_of.__getitem__, m[0])).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return pattern.sub(read, text)


def _tables() -> dict[tuple[str, str], dict[int, str]]:
    """For each pair of single-byte encodings, the characters of one and what their bytes are in the other."""
    if "tables" not in _more:
        made: dict[tuple[str, str], dict[int, str]] = {}
        for a, b in REREAD:
            if a in _MULTI_BYTE or b in _MULTI_BYTE or b == "utf_8":
                continue
            made[a, b] = {}
            for char, byte in _encodings()[a][0].items():
                try:
                    made[a, b][ord(char)] = bytes([byte]).decode(b)
                except UnicodeDecodeError:
                    continue
        _more["tables"] = made
    return _more["tables"]


def _reread(text: str, a: str, b: str) -> str:
    table = _tables().get((a, b))
    if table is not None:  # a run is read as a whole or not at all
        return _RUN.sub(lambda m: m[0].translate(table) if table.keys() >= set(map(ord, m[0])) else m[0], text)
    byte_of = _encodings()[a][0] if a not in _MULTI_BYTE else None

    def again(m: re.Match) -> str:
        run = m[0]
        try:
            raw = run.encode(a) if byte_of is None else bytes(ord(c) if c < "\x80" else byte_of[c] for c in run)
            return raw.decode(b)
        except (UnicodeError, KeyError):
            return run

    out = _RUN_AND_ONE.sub(again, text)
    return out if out != text else _RUN.sub(again, text)


def _c1_read(text: str) -> str:
    return _C1.sub(lambda m: m[0].encode("latin-1").decode("cp1252", "ignore") or m[0], text)


_C1 = re.compile("[\x80-\x9f]")


def utf8_neighbours(text: str) -> list[tuple[str, float]]:
    """Texts one reading as UTF-8 away, with the price of the step."""
    out = {numeric_references_read(text), _c1_read(text)}
    for name in READ_AS:
        byte_of, pattern = _encodings()[name]
        if pattern.search(text):
            out.add(_as_utf8(text, byte_of, pattern))
    return [(x, 0.3) for x in sorted(out - {text})]


def other_neighbours(text: str) -> list[tuple[str, float]]:
    """Texts one other pair of encodings away, with the price of the step."""
    prices: dict[str, float] = {}
    for a, b in REREAD:
        out = _reread(text, a, b)
        if out != text:
            # Two bytes that make one letter are less likely by chance than one that makes another.
            prices[out] = min(prices.get(out, 9.0), 1.5 if a in _MULTI_BYTE or b in _MULTI_BYTE else 3.0)
    return sorted(prices.items())


_CHAR_COST: dict[str, tuple[float, str, str]] = {}
_ORDINARY_PUNCTUATION = "“”‘’–—…«»¿¡„‚·•€£№★☆♥♪→←°©®™、。「」『』《》〈〉！？，．：；（）【】〜・ー％～"


def _char(c: str) -> tuple[float, str]:
    """(cost, class) of a character beyond ASCII; classes: l, u lower and upper case letters, w other letters, m marks, s the rest."""
    o, category = ord(c), unicodedata.category(c)
    if c == "�" or category in ("Co", "Cn", "Cs") or category == "Cc":
        return 12.0, "s"
    if c in _ORDINARY_PUNCTUATION:
        return 0.7 if c in "“”‘’–—…、。「」『』《》！？，．：；（）・" else 1.5, "p"
    if category[0] == "L" or category[0] == "M":
        kind = {"Ll": "l", "Lu": "u", "Lt": "u"}.get(category, "m" if category[0] == "M" else "w")
        if o < 0x100:
            return (4.0, "s") if c in "ªº" else (1.0, kind)
        if o < 0x180:
            return 1.3, kind
        if 0x1EA0 <= o <= 0x1EFF or c in "ƠơƯưǍǎȘșȚț":
            return 1.3, kind
        if 0x0410 <= o <= 0x044F or c in "Ёё" or 0x0391 <= o <= 0x03CE:
            return 1.0, kind
        if 0x0400 <= o <= 0x052F:
            return (1.2 if c in "іїєґІЇЄҐ" else 2.5), kind
        if 0x4E00 <= o <= 0x9FFF:
            try:
                return (1.4 if 0xB0 <= c.encode("gb2312")[0] <= 0xD7 else 3.0), "w"
            except UnicodeError:
                try:
                    c.encode("cp932")
                    return 2.0, "w"
                except UnicodeError:
                    return 4.5, "w"
        if 0xAC00 <= o <= 0xD7A3:
            return 1.3, "w"
        if 0x3041 <= o <= 0x30FE:
            return 1.2, "w"
        if 0xFF61 <= o <= 0xFF9F:
            return 4.0, "w"
        if 0x0590 <= o <= 0x0EFF:
            return 1.2, "w"
        return 4.0, kind
    if category == "Zs":
        return 2.5, "s"
    if category == "Cf":
        return 6.0, "s"
    return 5.0, "s"


def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return "latin"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if 0x400 <= o <= 0x52F:
        return "cyrillic"
    return "east" if 0x2E80 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7FF or 0xF900 <= o <= 0xFFDC else "other"


def _weighed_part(text: str) -> tuple[float, float]:
    """(cost, suspicion) of a part without spaces."""
    total, suspicion, before, last, last_script, turned, accents = 0.0, 0.0, "", "", "", False, 0
    for c in text:
        if c < "\x80":
            kind = "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "" if c >= " " else "s"
            script, value = ("latin" if kind in ("l", "u") else ""), 0.0
            if before < "\x80":
                before, last, last_script, turned, accents = c, kind, script, False, 0
                continue
        else:
            known = _CHAR_COST.get(c)
            if known is None:
                value, kind = _char(c)
                known = _CHAR_COST[c] = value, kind, _script(c) if kind in ("l", "u", "w") else ""
            value, kind, script = known
        total += value
        odd = 0.0
        if value > 1.6:
            odd += value - 1.4
        # Words of three and more letters of this range alone stand in no language; one letter held long is no word.
        accents = accents + (c != before) if "\xc0" <= c <= "\xff" else 0
        if accents > 2 and c != before:
            total += 2.5
            odd += 2.5
        if before:
            extra = 0.0
            turned = kind == "u" and (last == "l" or (turned and last == "u"))
            if turned:
                extra += 2.5 if last == "l" else 0.5  # upper case within a word, and each letter more
            if c >= "\x80" and before >= "\x80" and script == last_script == "latin":
                total += 0.5  # words of accented letters only are rare, but correct in some languages
            if script and last_script and script != last_script:
                extra += 3.0  # two scripts within a word
            if (kind == "s" and last in ("l", "u", "w", "s")) or (last == "s" and kind in ("l", "u", "w")):
                extra += 1.0
            if last == "p" and kind == "l" and before not in "‘’“«¿¡„—–「『（" and script == "latin":
                extra += 2.5  # a sign within a word
            total += extra
            odd += extra
        suspicion += odd
        before, last, last_script = c, kind, script
    hanging = _HANGING.findall(text)
    return total + 4.0 * len(hanging), suspicion + 4.0 * len(hanging)


#: A word of lower case that ends in one accented letter of upper case.
_HANGING = re.compile(r"(?<=[a-zà-öø-ÿ]{2})[À-ÖØ-Þ](?![^\W\d_])")


@lru_cache(maxsize=100_000)
def _judged_part(text: str) -> tuple[float, float, bool]:
    """Cost, suspicion, and whether any stretch is UTF-8 in the bytes of an encoding."""
    return *_weighed_part(text), any(_encodings()[n][1].search(text) for n in READ_AS)


def weighed(text: str) -> tuple[float, float]:
    """(cost, suspicion): how implausible the characters are, and the part that no correct text has."""
    total, suspicion = 0.0, 0.0
    for part in text.split(" "):
        if not part.isascii():
            x, y, _ = _judged_part(part)
            total += x
            suspicion += y
    return total, suspicion


def cost(text: str) -> float:
    """How implausible a text's characters are; 0 for ASCII."""
    return weighed(text)[0]


def _settled(text: str, suspicion: float) -> bool:
    """Whether nothing about a text asks for another reading."""
    return suspicion == 0 and not any(_judged_part(part)[2] for part in text.split(" ") if not part.isascii())


def cheapest(text: str, slack: float = 2.0, tail: float = 20.0) -> tuple[str, float]:
    """The text that the search reaches at the lowest cost, steps included, and that cost."""
    first, suspicion = weighed(text)
    best, lowest, doubt = text, first, suspicion
    queue = [(first, text, 0.0, suspicion)]
    visited = {hash(text)}
    while queue:
        at, state, paid, suspicion = heapq.heappop(queue)
        far = at >= lowest + tail
        if _settled(state, suspicion) or (far and doubt <= 0.15 * lowest):
            break
        done = False
        for step in (utf8_neighbours,) if far else (utf8_neighbours, other_neighbours):
            for out, price in step(state):
                if hash(out) in visited:
                    continue
                visited.add(hash(out))
                value, odd = weighed(out)
                value += paid + price
                done |= value < at and _settled(out, odd)
                if value < lowest:
                    best, lowest, doubt = out, value, odd
                if value < at + slack:
                    heapq.heappush(queue, (value, out, paid + price, odd))
            if done:
                break
    return best, lowest


#: U+FFFD, C1 controls, and the first half of a letter whose second half, a no-break space, was collapsed.
_LOST = re.compile("[�\x80-\x9f]|(?<=[a-zà-ÿ])Ã(?=\\s|$)")


def judged(text: str, least_gain: float = 2.5) -> tuple[str | None, bool] | None:
    """None for a value that is not garbled; else (restored text or None, whether something was lost)."""
    if text.isascii() and "&#" not in text:
        return None
    read = numeric_references_read(text)
    if read.isascii():
        return None
    if "�" in read:
        return None, True
    before, suspicion = weighed(read)
    lost = bool(_LOST.search(read))
    if not lost and _settled(read, suspicion):
        return None
    best, after = cheapest(read)
    gained = before - after >= least_gain
    if not gained and not lost:
        return None
    if not gained or _LOST.search(best):
        return None, True
    return best, False


def _garbled(fields: list[str]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field in fields:
                for row, value in zip(batch["row"], batch[field]):
                    found = judged(value) if value else None
                    if found is not None:
                        out.append((row, field, value, *found))
            yield pd.DataFrame(out, columns=["row", "field_name", "value", "restored", "lost"])

    return run


def garbled(df: DataFrame, identity: str, fields: list[str]) -> DataFrame:
    """(identity, field_name, value, restored, lost) of garbled values of the named columns; other columns are ignored."""
    source = spread(df.select(F.col(identity).cast("long").alias("row"), *[F.col(f).cast("string") for f in fields]))
    schema = "row long, field_name string, value string, restored string, lost boolean"
    return source.mapInPandas(_garbled(fields), schema).withColumnRenamed("row", identity)
