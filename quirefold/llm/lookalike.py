"""One consistent form for text that looks alike: compatibility forms, accents, invisible characters, look-alike letters.

A value is brought to plain form in two steps.

1. Invisible characters go, all kinds of spaces become the ordinary one, letters, digits, marks and ligatures take
   their compatibility form, accents are composed with their letters.
2. Script-aware repair: a token, that is a run of letters, which mixes Latin with another script is given its dominant
   script; the look-alikes of the other scripts are substituted if the result stands in the corpus vocabulary, the
   single-script tokens of all texts.  Where it does not stand there, the reading in the next script counts, if known.
   Tokens of one script, and mixed ones without a known reading, are left alone.

Tabs, line ends, ordinary punctuation and emoji are left alone.  Null and unreadable values are not reported.
Repeated rows are reported each; columns other than the named ones are ignored; texts are read whole.
"""

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut, spread

#: Look-alikes of Latin letters.  Fixed values: each pair looks the same in common fonts.
CYRILLIC_LATIN = "аa вb еe кk мm нh оo рp сc тt уy хx ѕs іi јj һh ԁd ԛq ԝw гr пn АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY ҺH ԚQ ԜW"
GREEK_LATIN = "αa εe ιi κk νv οo ρp τt υu χx γy ωw ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
ARMENIAN_LATIN = "օo սu հh ցg զq ոn"
TO_LATIN = {p[0]: p[1] for s in (CYRILLIC_LATIN, GREEK_LATIN, ARMENIAN_LATIN) for p in s.split()}

_LATIN = "A-Za-zªºÀ-ÖØ-öø-ʯᴀ-ᴥᵫ-ᵷᵹ-ᶚḀ-ỿⱠ-ⱿꜢ-ꞇꞋ-ꟊꬰ-ꭤ"
_OTHER = "Ͱ-ϿЀ-ԯԱ-֏א-תء-يऀ-෿ก-๛က-႟Ⴀ-ჿᄀ-ᇿሀ-᎙Ꭰ-Ᏽᲀ-ᲈἀ-῾ⲀⲁⲂ-ⳮ぀-ヿㄅ-ㆎㆠ-ㇿ㐀-䶿一-鿿ꀀ-ꓽꙀ-ꚟ가-힣豈-龎"
_EAST_ASIAN = "　-〿぀-ヿㄅ-ㆎㇰ-ㇿ㐀-䶿一-鿿가-힣豈-龎"
_state: dict = {}


def _tools() -> dict:
    if not _state:
        invisible = {c: None for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf" or c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= c <= 0xFE0F}
        spaces = {c: " " for c in range(0x110000) if unicodedata.category(chr(c)) == "Zs" and c != 0x20}
        gone = "".join(re.escape(chr(c)) for c in [*invisible, *spaces])
        _state.update(
            table=invisible | spaces,
            odd=re.compile(f"[{gone}]"),
            mixed=re.compile(f"[{_LATIN}][̀-ͯ]*[{_OTHER}]|[{_OTHER}][̀-ͯ]*[{_LATIN}]"),
            run=re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*"),
            latin=re.compile(f"[{_LATIN}]"),
            wide=re.compile(f"(?<![{_EAST_ASIAN}])[！-～](?![{_EAST_ASIAN}])"),
        )
    return _state


def _compatible(char: str) -> str:
    """The compatibility form of one letter, digit or mark; other characters stay."""
    return unicodedata.normalize("NFKC", char) if unicodedata.category(char)[0] in "LNM" else char


def folded(text: str) -> str:
    """Step 1; fullwidth punctuation is made ordinary unless it stands beside East Asian letters, where it is ordinary."""
    tools = _tools()
    out = text.translate(tools["table"]) if tools["odd"].search(text) else text
    if unicodedata.is_normalized("NFKC", out):
        return out
    out = unicodedata.normalize("NFC", "".join(_compatible(c) if ord(c) > 127 else c for c in out))
    out = tools["wide"].sub(lambda m: chr(ord(m[0]) - 0xFEE0), out)
    return unicodedata.normalize("NFC", out)


def mixed_tokens(text: str) -> list[str]:
    """The runs of letters of a folded text that mix Latin with another script."""
    tools = _tools()
    if text.isascii() or not tools["mixed"].search(text):
        return []
    return [m for m in tools["run"].findall(text) if tools["mixed"].search(m)]


def is_plain(text: str) -> bool:
    """Whether a text is in plain form."""
    if text.isascii():
        return True
    return folded(text) == text and not mixed_tokens(text)


@cache
def _look_alikes() -> dict[str, dict[str, str]]:
    """For each script, what stands in it for a letter of another."""
    to = {"LATIN": TO_LATIN}
    for script, pairs in (("CYRILLIC", CYRILLIC_LATIN), ("GREEK", GREEK_LATIN), ("ARMENIAN", ARMENIAN_LATIN)):
        own = {p[1]: p[0] for p in reversed(pairs.split())}
        to[script] = own | {other: own[latin] for other, latin in TO_LATIN.items() if latin in own}
    return to


def _script(char: str) -> str:
    return "LATIN" if _tools()["latin"].match(char) else unicodedata.name(char, "").split(" ")[0]


def readings(token: str) -> list[str]:
    """A mixed token in each of its scripts that has look-alikes for all letters of the others; the dominant script first, Latin before an equal."""
    scripts = [_script(c) for c in unicodedata.normalize("NFC", token) if not unicodedata.combining(c)]
    out = []
    for script in sorted(set(scripts), key=lambda x: (-scripts.count(x), x != "LATIN", x)):
        to = _look_alikes().get(script)
        if to is None:
            continue
        plain = unicodedata.normalize("NFC", "".join(c if _script(c) == script else to.get(c, c) for c in token))
        if all(_script(c) == script or unicodedata.combining(c) for c in plain):
            out.append(plain)
    return out


def repaired(token: str) -> str:
    """A mixed token in its dominant script, or the next that its letters allow; itself if there is none."""
    return next(iter(readings(token)), token)


def _strings(value: str | None, is_json: bool) -> list[str]:
    if value is None:
        return []
    if not is_json:
        return [value]
    try:
        parts = json.loads(value)
    except ValueError:
        return []
    return [p for p in parts if isinstance(p, str)] if isinstance(parts, list) else []


def _odd_values(fields: dict[str, bool], with_text: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, is_json in fields.items():
                for row, value in zip(batch["row"], batch[field]):
                    if not value or (value.isascii() and not (is_json and "\\u" in value)):
                        continue
                    strings = _strings(value, is_json)
                    if all(is_plain(s) for s in strings):
                        continue
                    if with_text:
                        step = [folded(s) for s in strings]
                        out.append((row, field, step, sorted({t for s in step for t in mixed_tokens(s)})))
                    else:
                        out.append((row, field))
            if with_text:
                yield pd.DataFrame(out, columns=["row", "field_name", "strings", "tokens"])
            else:
                yield pd.DataFrame(out, columns=["row", "field_name"])

    return run


def _vocabulary(fields: dict[str, bool]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run_of = _tools()["run"]
        for batch in batches:
            seen: set[str] = set()
            for field, is_json in fields.items():
                for value in batch[field]:
                    for s in _strings(value, is_json):
                        seen.update(run_of.findall(s if s.isascii() else folded(s)))
            if not seen:
                continue
            yield pd.DataFrame({"word": sorted({w.lower() for w in seen if w.isascii() or not mixed_tokens(w)})}, dtype=object)

    return run


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(token, k, plain, plain.lower()) for token in batch["token"] for k, plain in enumerate(readings(token))]
        yield pd.DataFrame(out, columns=["token", "rank", "plain", "word"])


def _renewed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        out = []
        for strings, pairs in zip(batch["strings"], batch["pairs"]):
            known = {p["token"]: p["plain"] for p in pairs} if pairs is not None else {}
            new = list(strings)
            if known:
                new = [_tools()["run"].sub(lambda m: known.get(m[0], m[0]), s) for s in strings]
            out.append((new, sum(len(mixed_tokens(s)) for s in new)))
        yield pd.DataFrame({"row": batch["row"].tolist(), "field_name": batch["field_name"].tolist(), "plain": [o[0] for o in out], "unresolved": [o[1] for o in out]})


def _source(df: DataFrame, identity: str, fields: dict[str, bool]) -> DataFrame:
    return spread(df.select(F.col(identity).cast("long").alias("row"), *[F.col(f) for f in fields]))


def odd_values(df: DataFrame, identity: str, fields: dict[str, bool]) -> DataFrame:
    """(identity, field_name) of values that are not in plain form; ``fields`` tells for each column whether it is a JSON array."""
    source = _source(df, identity, fields)
    return source.mapInPandas(_odd_values(fields, False), "row long, field_name string").withColumnRenamed("row", identity)


def plain_values(df: DataFrame, identity: str, fields: dict[str, bool]) -> DataFrame:
    """(identity, field_name, plain, unresolved): the plain strings of values that are not in plain form.

    ``unresolved`` counts mixed-script tokens for which no reading stands in the corpus vocabulary; they are kept as they are.
    """
    source = _source(df, identity, fields)
    # Three uses follow; the odd values are a small part of all texts.
    odd = cut(source.mapInPandas(_odd_values(fields, True), "row long, field_name string, strings array<string>, tokens array<string>"))
    words = source.mapInPandas(_vocabulary(fields), "word string").distinct()
    tokens = odd.select(F.explode("tokens").alias("token")).distinct().mapInPandas(_readings, "token string, rank int, plain string, word string")
    known = tokens.join(words, "word", "left_semi").groupBy("token").agg(F.min_by("plain", "rank").alias("plain"))
    pairs = (
        odd.select("row", "field_name", F.explode("tokens").alias("token"))
        .join(known, "token")
        .groupBy(F.col("row").alias("pairs_row"), F.col("field_name").alias("pairs_field"))
        .agg(F.collect_list(F.struct("token", "plain")).alias("pairs"))
    )
    return (
        odd.select("row", "field_name", "strings")
        .join(pairs, F.col("row").eqNullSafe(F.col("pairs_row")) & (F.col("field_name") == F.col("pairs_field")), "left")
        .select("row", "field_name", "strings", "pairs")
        .mapInPandas(_renewed, "row long, field_name string, plain array<string>, unresolved long")
        .withColumnRenamed("row", identity)
    )
