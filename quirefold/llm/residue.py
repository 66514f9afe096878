"""Template residue, filler, error pages and script notices among the lines of records.

1. One pass of an Aho-Corasick automaton over each text finds the triggers of ``RULES``; a rule's pattern runs only
   on lines that hold one of its triggers, so most lines are never matched against a pattern.
2. Lines with evidence are normalised (trimmed, lower case, digits made alike) and counted by host: in how many of the
   host's records does the line stand?  Lines without evidence decide nothing, so they are not counted.
3. Recurrent boilerplate is subtracted, whatever evidence it holds: a line that stands in at least ``recurrent`` records and
   in at least the share ``boilerplate`` of the records of its host belongs to the host's page frame, not to the record.
   Only records that hold other lines besides are counted, and only from them is it subtracted: a line that is all there is frames nothing.
   An error page or a notice that merely occurs often stands in a few records of a hundred and is kept.
4. A record with evidence in what is left, the residual, is reported with the kinds it shows.

Filler of invented Latin is told by its form (``pseudo_latin``), not by a list of its words.

Null, unreadable, empty and blank texts hold no evidence.  Repeated rows are judged alike; a line that stands twice in a record
counts once.  A null host is a host of its own.  Columns other than the three named ones are ignored, so extra columns
cannot clash.  Texts are read whole.
"""

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut, spread

_ID = r"[A-Za-z_][\w.\[\]]*"
_CAPS = r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*"
_UNSET = r"(?:undefined|NaN|null|None|nil|NULL)"
#: Before the first word of a sentence or line.
_B = r"(?:^|(?<=[.!?…:\"”’)\]>]\s))"
_NAMES = "body content excerpt paragraph title text name author chapter summary link date".split()
_NAME = "(?:" + "|".join(_NAMES) + ")"
_STATUS = "not found|forbidden|unauthorized|access denied|bad request|bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|unknown origin error|method not allowed|request time-?out|gone"
_STATUS_TRIGGERS = "not found|forbidden|unauthorized|access denied|bad request|bad gateway|gateway time|internal server error|unavailable|too many requests|unknown origin|not allowed|request time|gone".split("|")
#: Kinds of evidence: template marks and values never set, filler, error and access pages, notices that scripts are needed.
TEMPLATE, FILLER, ERROR_PAGE, SCRIPT_NOTICE = "template", "filler", "error_page", "script_notice"

#: (kind, triggers in lower case, pattern).  Patterns of template marks see the line as it is, all others in lower case.
RULES: list[tuple[str, list[str], str]] = [
    (TEMPLATE, ["{{"], r"\{\{\{?\s*[^{}\s][^{}]*\}\}"),
    (TEMPLATE, ["${", "#{"], rf"[$#]\{{\s*{_ID}[^{{}}]*\}}"),
    (TEMPLATE, ["<%"], r"<%[=#\-]?\s*[^%>]+%>"),
    (TEMPLATE, ["{%"], r"\{%-?\s*[^%{}]+%\}"),
    (TEMPLATE, ["<!--"], rf"<!--\s*{_ID}\s*-->"),
    (TEMPLATE, ["%%"], rf"%%(?:{_CAPS}|[a-z_.]+)%%"),
    (TEMPLATE, ["@@"], rf"@@(?:{_CAPS}|[a-z_.]+)@@"),
    (TEMPLATE, ["__"], rf"(?<![A-Za-z0-9_])__(?:{_CAPS}|[a-z]+(?:_[a-z]+)*)__(?![A-Za-z0-9_])"),
    (TEMPLATE, ["[["], rf"\[\[{_CAPS}\]\]"),
    (TEMPLATE, ["_"], r"\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\]"),
    (TEMPLATE, [f"[{x}]" for x in _NAMES], rf"\[{_NAME.upper()}\]"),
    (TEMPLATE, ["|"], rf"\{{{_ID}\s*\|[^{{}}]*\}}"),
    (TEMPLATE, ["{"], rf"\{{(?:[a-z_]\w*(?:[._\[][\w.\[\]]*)+|\d+|{_NAME})\}}"),
    (TEMPLATE, ["%s", "%d", "%("], r"(?<![\w%])%(?:s|d|\(\w+\)[sd])(?!\w)"),
    (TEMPLATE, ["$"], r"(?<!\w)\$[a-z]+(?:_[a-z]+)*\$(?!\w)"),
    (TEMPLATE, [":"], rf"(?<![\w:]):(?:{_NAME}|[a-z]\w*(?:[._\[][\w.\[\]]*)+):(?![\w:])"),
    (TEMPLATE, ["[object "], r"\[object [A-Z]\w*\]"),
    (TEMPLATE, ["undefined", "nan", "null", "none", "nil"], rf"{_B}{_UNSET}(?:[\s,;]+{_UNSET})+(?=\s*$|\s+[\"“A-Z%$#@_\[{{<])"),
    (TEMPLATE, ["undefined", "nan", "null", "none", "nil"], rf"{_B}{_UNSET}(?=\s*$|\s+[\"“A-Z%$#@_\[{{<])"),
    (TEMPLATE, ["undefined", "null", "none", "nil"], rf"\b(?:Dear|Hello|Hi|Previous:|Next:|Chapter|Volume|part|by) {_UNSET}\b(?=[.,:!?]|\s*$)"),
    (TEMPLATE, ["nan", "undefined"], r"\bNaN\b|(?<=\w )undefined(?=[.,!?]|\s*$)"),
    (FILLER, ["lorem ipsum"], r"\blorem ipsum (?:dolor|sit|amet|\w+ (?:dolor|sit|amet))\b"),
    (FILLER, ["um ", "um.", "um,", "ae ", "que ", "us, "], ""),
    (FILLER, ["blindtext", "texto de", "texte", "teks contoh"], r"\bblindtext\b|\btexto de (?:ejemplo|relleno|exemplo)\b|\btexte? (?:factice|de remplissage)\b|\bteks contoh\b"),
    (
        FILLER,
        ["dummy", "placeholder", "sample", "filler", "test text", "test paragraph"],
        r"\b(?:dummy|placeholder|sample|filler|test) (?:text|paragraph|content)\b[^.!?]{0,60}\b(?:layout|replace|here|until|page|used)\b|\bsample paragraph\b",
    ),
    (FILLER, ["your own", "fill the "], r"\breplace (?:it|this|me|them) with your own (?:words|text|content)\b|\bhere to fill the (?:page|space)\b"),
    (FILLER, ["[insert", "<paste", "<insert", "goes here)"], r"\[insert [^\]]{2,60}\]|<(?:paste|insert) [^>]{2,60}>|\((?:chapter|text|body|content)[^()]{0,30}\bgoes here\)"),
    (FILLER, ["todo", "xxx", "to follow", "fill in", "fill this"], r"\btodo: ?(?:add|write|fill|insert|replace|translate)|\bxxx (?:fill|fix|add|todo)\b|-- ?text to follow\b|\btext to follow\b\W*$|\bfill (?:this )?in before (?:release|publi\w+)\b"),
    (FILLER, ["test test", "blah blah", "asdf", "qwer", "jkl", "xxxx"], r"\btest test\b|\bblah blah\b|\basdf\b|\bqwer(?:ty)?\b|\bjkl\b|\bxxxx+\b"),
    (FILLER, ["aaaa", "bbbb", "cccc", "dddd", "eeee"], r"(?:\b([a-z])\1{3,}\b\W*){2,}"),
    (FILLER, ["loading"], r"\bloading (?:the )?(?:chapter|content|page|text|story|next)\b|(?:^\s*|(?<=[.!?\"”] ))loading ?(?:\.\.\.|…)"),
    (FILLER, ["please wait while"], r"\bplease wait while (?:the )?(?:chapter|page|content|text|book|story|site|reader) (?:is |are )?(?:load|being)"),
    (FILLER, ["being fetched", "being loaded", "being prepared"], r"\bcontent is being (?:fetched|loaded|prepared)\b"),
    (
        FILLER,
        ["cargando", "chargement", "carregando", "geladen", "memuat", "dimuat"],
        r"\bcargando (?:el|la|los) \w+|\bchargement (?:du|de|en)\b|\bcarregando\b|\bwird geladen\b|\bsedang (?:memuat|dimuat)\b|\bmemuat (?:bab|halaman)\b",
    ),
    (FILLER, ["loading", "please wait"], r"^\s*(?:loading|please wait)\s*[.!…]*\s*$"),
    (ERROR_PAGE, _STATUS_TRIGGERS, rf"(?:^|[\s>])[45]\d\d (?:{_STATUS})"),
    (ERROR_PAGE, _STATUS_TRIGGERS + ["error"], rf"<(?:h\d|title|center|b)>\s*(?:\d{{3}} )?(?:{_STATUS}|error)"),
    (ERROR_PAGE, ["error 4", "error 5", "error code"], r"(?:^|(?<=[.!?\"”>] ))error (?:code:? ?)?[45]\d\d(?=\s*$|[.:]|\s+[\"“a-z<])"),
    (ERROR_PAGE, ["access denied"], r"^\s*access denied(?=\s*$|[.!]|\s+your )|(?<=[.!?\"”] )access denied(?=\s*$|[.!]\s|\s+(?:your|you) )"),
    (ERROR_PAGE, [x for x in _STATUS_TRIGGERS if x != "gone"], rf"^\s*(?:page )?(?:{_STATUS.replace('|gone', '')})\s*[.!]?\s*$"),
    (ERROR_PAGE, ["gone", "error"], r"^\s*(?:gone|error)\s*[.!]?\s*$"),
    (ERROR_PAGE, ["address has been", "permission to"], r"\byour (?:ip )?address has been (?:blocked|banned)\b|\byou (?:do not|don't) have permission to (?:access|view)\b"),
    (
        ERROR_PAGE,
        ["went wrong", "not find", "may have", "not be found"],
        r"\bsomething went wrong on our (?:side|end)\b|\b(?:we|the server|the site) (?:could ?n[o']t|can ?not) find (?:that|the|this) (?:chapter|page|file|document|story)\b"
        r"|\bmay have (?:been )?(?:re)?moved or (?:been )?(?:taken down|removed|deleted)\b|\b(?:page|file|document) (?:could not be|was not) found\b",
    ),
    (ERROR_PAGE, ["database", "administrator", "maintenance"], r"\b(?:could not|cannot|failed to|unable to) connect to (?:the |our )?(?:database|server)\b|\bcontact (?:the|your|our) (?:site |system )?administrator\b|\b(?:site|server|page) is down for maintenance\b"),
    (ERROR_PAGE, ["too many requests", "requested "], r"\b(?:sending|sent|made|received) too many requests\b|\brequested (?:address|url|page|resource)[^.]{0,30} (?:was not|could not be) (?:served|found)\b"),
    (ERROR_PAGE, ["traceback", "error '", "exception", "stack trace"], r"\btraceback\b[^.]{0,40}\bline \d+|\b(?:key|type|value|attribute|reference|syntax|runtime)error '|\buncaught exception\b|\bstack trace:"),
    (
        ERROR_PAGE,
        ["encontrada", "ditemukan", "nicht gefunden", "cette page", "introuvable", "servidor", "serveur", "serverfehler", "kesalahan"],
        r"\bp[aá]gina no encontrada\b|\bhalaman tidak ditemukan\b|\bseite nicht gefunden\b|\bcette page n['’]existe\b|\bpage introuvable\b|\bp[aá]gina n[aã]o encontrada\b|\berror? interno d[oe]l? servidor\b|\berreur interne du serveur\b|\binterner serverfehler\b|\bkesalahan server\b",
    ),
    (ERROR_PAGE, ["checking your", "human", "captcha"], r"\bchecking your [\w ]{3,20} before\b|\bverify(?:ing)? (?:that )?you are (?:a )?human\b|\bcomplete the captcha\b"),
    (ERROR_PAGE, ["request id", "ref: ", "try again in"], r"(?:^|(?<=[.!?>] ))request id:? [0-9a-f]{8,}|(?:^|(?<=[.!?>] ))ref: [0-9a-f]{8,}\b|\btry again in \d+ seconds\b"),
    (ERROR_PAGE, ["denegado", "verweigert", "refus", "negado", "ditolak"], r"\bacceso denegado\b|\bzugriff verweigert\b|\bacc[eè]s refus[eé]\b|\bacesso negado\b|\bakses ditolak\b"),
    (SCRIPT_NOTICE, ["script", "cookies"], r"\b(?:enable|allow|turn on|activate) (?:java ?scripts?|cookies|scripts)\b(?! (?:that|which|who))"),
    (SCRIPT_NOTICE, ["script"], r"\bjava ?script is (?:disabled|off|turned off|required|not enabled)\b|\bjava ?script (?:must|needs to) be\b"),
    (SCRIPT_NOTICE, ["script", "cookies"], r"\b(?:needs|requires) (?:java ?script|scripts|cookies)\b"),
    (SCRIPT_NOTICE, ["script"], r"\bdoes not (?:run|support|allow) (?:the |java)?scripts?\b|<noscript>|\bscripts and cookies must be\b"),
    (SCRIPT_NOTICE, ["blocker"], r"\b(?:noticed|detected) an? ad ?-?blocker\b|\bad ?-?blocker (?:detected|is on)\b"),
    (
        SCRIPT_NOTICE,
        ["javascript", "java script"],
        r"\bbitte aktiviere?n?(?: sie)? java ?script|\bveuillez activer java ?script|\bactiv[ae] (?:o )?java ?script|\bative (?:o )?java ?script|\baktifkan java ?script|\bhabilit[ae] (?:o |el )?java ?script|\bwłącz javascript|\bвключите javascript|\bjavascriptを有効",
    ),
]


#: Latin word endings, and words that real prose of the languages of these texts can hardly do without.
_LATIN_ENDING = re.compile(r"[a-z]{2,}(?:um|us|is|it|or|ae|que|em|et|io|unt|am|os)$")
_FUNCTION_WORDS = frozenset(
    "the a an and or of to in on at is was were are be he she it his her they you i we not that this with for from by as but had has have "
    "de la el los las y en un una que se no por con su le les des du et une dans il elle ne pas est der die das und den dem ein eine zu mit von nicht ist "
    "o os da do uma em para com yang di dan ke itu ini dengan".split()
)
_SENTENCE = re.compile(r"[^.!?…]+")
_WORDS = re.compile(r"[^\W\d_]+")


def pseudo_latin(low: str, least: int = 5, share: float = 0.55) -> bool:
    """Whether a sentence of at least ``least`` words reads like invented Latin: most words have Latin endings, none is a function word."""
    for sentence in _SENTENCE.findall(low):
        words = _WORDS.findall(sentence)
        if len(words) < least or not _FUNCTION_WORDS.isdisjoint(words):
            continue
        if sum(1 for w in words if w == "sit" or _LATIN_ENDING.search(w)) >= share * len(words):
            return True
    return False


class Judge:
    """The rules, ready to be used on a worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        rules: dict[str, list[int]] = {}
        for n, (_, triggers, _) in enumerate(RULES):
            for t in triggers:
                rules.setdefault(t, []).append(n)
        for t, own in rules.items():
            self.automaton.add_word(t, tuple(own))
        self.automaton.make_automaton()
        self.patterns = [re.compile(p).search if p else pseudo_latin for _, _, p in RULES]

    def line(self, line: str) -> list[str]:
        """The kinds of evidence in a line."""
        low = line.lower()
        triggered: set[int] = set()
        for _, own in self.automaton.iter(low):
            triggered.update(own)
        found: set[str] = set()
        for n in triggered:
            kind = RULES[n][0]
            if kind not in found and self.patterns[n](line if kind == TEMPLATE else low):
                found.add(kind)
        return sorted(found)

    def marked(self, texts: list[str]) -> bool:
        """Whether any trigger stands in any of the texts."""
        return next(self.automaton.iter("\n".join(texts).lower()), None) is not None


def split_lines(value: str | None) -> list[str]:
    """The lines of a JSON array of strings; unreadable values have none."""
    try:
        parts = json.loads(value) if value else None
    except ValueError:
        parts = None
    if not isinstance(parts, list):
        return []
    return [x for p in parts if isinstance(p, str) for x in re.split(r"[\r\n]+", p) if x.strip()]


def normal(line: str) -> str:
    """The form in which lines are counted."""
    return line.strip().lower().translate(_DIGITS)


_DIGITS = str.maketrans("123456789", "000000000")


def _evidence() -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge()
        for batch in batches:
            out = []
            for row, host, value in zip(batch["row"], batch["host"], batch["text"]):
                lines = split_lines(value)
                if not judge.marked(lines):
                    continue
                found = [(x, kinds) for x in lines if (kinds := judge.line(x))]
                for line, kinds in found:
                    key = hashlib.blake2b(normal(line).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    out.append((row, host, key, kinds, len(found) < len(lines)))
            yield pd.DataFrame(out, columns=["row", "host", "line", "kinds", "beside"])

    return run


def line_counts(evidence: DataFrame) -> DataFrame:
    """(host, line, times): in how many records of its host each line with evidence stands beside other lines."""
    once = evidence.where("beside").select("row", "host", "line").distinct()
    return once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("times"))


def residue(
    chapters: DataFrame, identity: str = "row_id", host: str = "novel_id", text: str = "paragraphs_json", recurrent: int = 5, boilerplate: float = 0.2
) -> DataFrame:
    """(identity, kinds, evidence_lines, boilerplate_lines) of records whose residual holds evidence.

    A line in at least ``recurrent`` records that are at least the share ``boilerplate`` of its host's records is boilerplate there.
    """
    rows = chapters.select(F.col(identity).cast("long").alias("row"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), F.col(text).alias("text"))
    # A few lines of all; three uses follow.
    evidence = cut(spread(rows.where("text IS NOT NULL")).mapInPandas(_evidence(), "row long, host string, line binary, kinds array<string>, beside boolean"))
    frames = (
        line_counts(evidence)
        .where(F.col("times") >= recurrent)
        .join(rows.groupBy("host").agg(F.count(F.lit(1)).alias("records")), "host")
        .where(F.col("times") >= F.col("records") * F.lit(boilerplate))
        .select("host", "line", F.lit(True).alias("framed"))
    )
    judged = evidence.join(frames, ["host", "line"], "left")
    left = F.col("framed").isNull() | ~F.col("beside")
    return (
        judged.groupBy("row")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(left, F.col("kinds")))))).alias("kinds"),
            F.count_if(left).alias("evidence_lines"),
            F.count_if(~left).alias("boilerplate_lines"),
        )
        .where("evidence_lines > 0")
        .withColumnRenamed("row", identity)
    )
