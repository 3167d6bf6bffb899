"""Operator 6: secret scan through a trigram inverted index (DataFrame functions only).

``trigram_query`` derives from each rule's regex a Boolean query: an OR of sets of
trigrams (of the lower-cased text) of which a match must hold one set whole. Documents
post the trigrams that any query names; intersecting the postings of a set (a bit mask
per text and set) gives the candidate texts, and only those are verified with the regex.
A rule without mandatory trigrams scans every text.

Texts are keyed by their MD5, so copies share postings. One shuffle of the texts brings
the candidates' rules to them; a key with many copies is split by AQE (skew join).

Defined results: NULL is the empty text and has no span; spans are code points, end
exclusive; matches of one rule never overlap, spans of different rules may.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser  # the standard library's own regex parse tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import free_name


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must have ``least`` characters; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The base rules, in the order that breaks ties between spans.
BASE_RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               group=2, least=6, any_case=True),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", r"[0-9a-f]{24,}", least=24),  # whole runs, as [0-9a-f]+ with 24 and more
)
# Public token formats that the scan adds.
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    SecretRule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 256  # a finite set of more strings counts as unknown (a wider query)
_MOST_BITS = 60  # trigrams of one set that fit its mask


def _strings(op, arg) -> set[str] | None:
    """All strings of a parse node, or None if there are many or no bound."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg)}
    if name == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                out.add(chr(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                out |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT":
        low, high, sub = arg
        one = _sequence_strings(sub)
        if one is None or high == _parser.MAXREPEAT or high > 8 or len(one) ** high > _MOST_STRINGS:
            return None
        return {"".join(x) for k in range(low, high + 1) for x in product(sorted(one), repeat=k)}
    return {""} if name in ("AT", "ASSERT", "ASSERT_NOT") else None


def _sequence_strings(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        s = _strings(op, arg)
        if s is None or len(out) * len(s) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _needed(seq) -> list[set[str]]:
    """Sets of strings; every match holds at least one string of each set."""
    out, current = [], {""}
    for op, arg in seq:
        s = _strings(op, arg)
        if s is not None and len(current) * len(s) <= _MOST_STRINGS:
            current = {a + b for a in current for b in s}
            continue
        out.append(current)
        current = s if s is not None else {""}
        if s is None and str(op) == "SUBPATTERN":
            out += _needed(arg[-1])
        elif s is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
            out += _needed(arg[2])
    return [*out, current]


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _smallest(sets) -> list[frozenset[str]]:
    """Without sets that contain another one (the smaller is the weaker demand)."""
    sets = set(sets)
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of trigram sets (lower case) for a regex; [] if it has no mandatory trigram."""
    query: list[frozenset[str]] = [frozenset()]
    for strings in _needed(_parser.parse(pattern)):
        if any(len(s) < 3 for s in strings):
            continue
        clause = _smallest(_trigrams(s.lower()) for s in strings)
        if len(query) * len(clause) <= 64:  # leaving a clause out only widens the query
            query = _smallest(a | b for a in query for b in clause)
    return [] if frozenset() in query else [frozenset(sorted(s)[:_MOST_BITS]) for s in query]


def postings(texts: DataFrame, trigrams: list[str], key: str, text: str) -> DataFrame:
    """The inverted index: a row (trigram, key) for each named trigram of a text."""
    lists = F.transform(
        F.array(F.lower(qcol(text))),  # lower-cased once a row
        lambda low: F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t)))
    return texts.select(qcol(key).alias("key"), F.explode(F.flatten(lists)).alias("trigram"))


def candidates(texts: DataFrame, rules=RULES, key: str = "key", text: str = "text") -> DataFrame:
    """(key, rules): the kinds whose trigram query a text's postings satisfy."""
    wanted = []
    for r in rules:
        for i, clause in enumerate(trigram_query(r.pattern)):
            full = (1 << len(clause)) - 1
            wanted += [(r.kind, i, t, 1 << b, full) for b, t in enumerate(sorted(clause))]
    spark = texts.sparkSession
    sets = spark.createDataFrame(wanted, "kind string, part int, trigram string, bit bigint, full bigint")
    index = postings(texts, sorted({w[2] for w in wanted}), key, text)
    # the broadcast side has a row per rule and trigram: its size is the rule set's
    hits = (index.join(F.broadcast(sets), "trigram")
            .groupBy("key", "kind", "part", "full").agg(F.bit_or("bit").alias("seen"))
            .where("seen = full"))
    return hits.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: SecretRule, number: int) -> Column:
    """Array of (start, kind, end) of one rule's matches in a text, from the lengths of
    the matches and of the pieces between them."""
    regex = F.lit(rule.regex)
    pieces = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    part = F.regexp_extract_all(text, regex, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), part.alias("part"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state, x):
        start = (state["at"] + F.length(x["piece"])).cast("int")
        end = (start + F.length(x["whole"])).cast("int")
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"),
                        F.when(F.length(x["part"]) >= rule.least, F.concat(state["out"], F.array(span)))
                        .otherwise(state["out"]).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return F.when(F.rlike(text, regex), found).otherwise(empty)


def scan(docs: DataFrame, text: str = "text", rules=RULES, keep=None):
    """(table, name): ``keep`` columns (default: all) and the array of all spans, sorted
    by start, then kind; ``kind`` is the place of the rule in ``rules``."""
    name = free_name("spans_", docs)
    key, found, body = (free_name(x, docs) for x in ("text_key_", "rules_", "body_"))
    kept = list(docs.columns if keep is None else keep)
    value = F.coalesce(qcol(text).cast("string"), F.lit(""))
    keyed = docs.select(*[qcol(c) for c in kept], value.alias(body), F.unhex(F.md5(value)).alias(key))
    listed = candidates(keyed.select(key, body), rules, key, body).select(
        F.col("key").alias(key), F.col("rules").alias(found))
    joined = keyed.join(listed, key, "left")
    arrays = []
    for i, r in enumerate(rules):
        spans = _spans(F.col(f"`{body}`"), r, i)
        if trigram_query(r.pattern):  # verify candidates; other rules scan every text
            spans = F.when(F.array_contains(F.col(f"`{found}`"), r.kind), spans)
        arrays.append(F.coalesce(spans, F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    out = joined.select(*[qcol(c) for c in kept], F.array_sort(F.concat(*arrays)).alias(name))
    return out, name


def span_list(spans: Column, rules=RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules=RULES,
           length: str | None = None) -> DataFrame:
    """All documents; every span (overlapping ones united) is replaced by ``mark``.

    ``length`` names a column that holds the text's code points and is brought up to
    date for changed texts.
    """
    out, name = scan(docs, text, rules)
    spans, body = F.col(f"`{name}`"), qcol(text)
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def step(s, x):
        more = F.when(x["start"] >= s["at"], F.concat(
            s["text"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).otherwise(s["text"])
        return F.struct(more.alias("text"), F.greatest(s["at"], x["end"]).alias("at"))

    clean = F.aggregate(spans, state, step, lambda s: F.concat(
        s["text"], F.substring(body, s["at"] + 1, F.length(body))))
    changed = F.size(spans) > 0
    fresh = free_name("clean_", out)
    out = out.withColumn(fresh, F.when(changed, clean).otherwise(body))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(f"`{fresh}`").alias(c))
        elif c == length:
            columns.append(F.when(changed, F.length(F.col(f"`{fresh}`")).cast(docs.schema[c].dataType))
                           .otherwise(qcol(c)).alias(c))
        else:
            columns.append(qcol(c))
    return out.select(*columns)
