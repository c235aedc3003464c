"""Secret scans with a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression.  A Boolean query over trigrams follows from
it: alternatives, each a set of trigrams that a match must contain.  The index
has a posting (trigram, document) for each trigram of the queries that a text
contains; the postings of an alternative's trigrams are intersected, and only
the documents that are left are searched with the expression.  Rules without
mandatory trigrams search every text.

Spans are [start, end) in code points, found leftmost and without overlap for
each rule; then matches that are too short are dropped.

Edge cases.  Null and empty texts have no spans.  Rows that repeat an id share
their postings; each row is searched on its own, so the spans are those of its
text.  Rows without id are searched with every rule.  Long texts are searched
whole.  Columns that come along do so in a struct, others aren't read, so none
can clash.  No rows, no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import input_columns


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and Python share.  group: the part
    whose length has to be least_chars at least."""

    kind: str
    pattern: str
    group: int = 0
    least_chars: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The base rules, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Rules that the method adds: prefixes of tokens that services publish.
ADDED = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Query = list[frozenset[str]]  # any of these sets of trigrams, all of a set
ANY: Query = [frozenset()]
#: Strings that a part may stand for are listed up to this number.
_LISTED = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _either(parts: list[Query]) -> Query:
    out = [s for q in parts for s in q]
    return ANY if frozenset() in out else [s for s in dict.fromkeys(out) if not any(o < s for o in out)]


def _all(parts: list[Query]) -> Query:
    out = ANY
    for q in parts:
        if len(out) * len(q) <= _LISTED:
            out = [x | y for x in out for y in q]
    return _either([out])


class _Parser:
    """Reads an expression as far as trigrams need it: literals, classes,
    groups, alternatives and repeats.  A node is (kind, value, least, most):
    "one" of a list of characters (None: any), or a "group" of branches, which
    are lists of nodes.  Whatever else is in an expression raises ValueError.
    """

    CLASSES = "dDwWsS"

    def __init__(self, pattern: str):
        self._text, self._at = pattern, 0

    def parse(self) -> list[list[tuple]]:
        out = self._branches()
        if self._at < len(self._text):
            raise ValueError(f"can't read {self._text!r} at {self._at}")
        return out

    def _peek(self) -> str:
        return self._text[self._at : self._at + 1]

    def _take(self, n: int = 1) -> str:
        part = self._text[self._at : self._at + n]
        if len(part) < n:
            raise ValueError(f"{self._text!r} ends too early")
        self._at += n
        return part

    def _branches(self) -> list[list[tuple]]:
        out: list[list[tuple]] = [[]]
        while (c := self._peek()) and c != ")":
            if c == "|":
                self._take()
                out.append([])
            else:
                out[-1].append(self._repeated(self._atom()))
        return out

    def _atom(self) -> tuple[str, object]:
        c = self._take()
        if c == "(":
            if self._peek() == "?":
                if self._take(2) != "?:":
                    raise ValueError("groups have no options but ?:")
            inner = self._branches()
            if self._take() != ")":
                raise ValueError("a group doesn't end")
            return "group", inner
        if c == "[":
            return "one", self._class()
        if c == ".":
            return "one", None
        if c == "\\":
            return "one", self._escape()
        if c in "^$*+?{":
            raise ValueError(f"{c} isn't read here")
        return "one", [c]

    def _escape(self) -> list[str] | None:
        c = self._take()
        if c == "x":
            return [chr(int(self._take(2), 16))]
        if c in self.CLASSES:
            return None
        if c.isalnum():
            raise ValueError(f"\\{c} isn't read")
        return [c]

    def _class(self) -> list[str] | None:
        """Its characters; None for those of ranges, classes and complements."""
        found: list[str] | None = []
        if self._peek() == "^":
            found = None
        first = True
        while first or self._peek() != "]":
            first, c = False, self._take()
            one = self._escape() if c == "\\" else [c]
            if self._peek() == "-" and self._text[self._at + 1 : self._at + 2] not in ("]", ""):
                self._take()
                end = self._take()
                if end == "\\":
                    self._escape()
                one = None
            found = None if found is None or one is None else found + one
        self._take()
        return found

    def _repeated(self, atom: tuple[str, object]) -> tuple:
        c, least, most = self._peek(), 1, 1
        if c and c in "*+?":
            self._take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif c == "{":
            found = re.compile(r"\{(\d*)(,?)(\d*)\}").match(self._text, self._at)
            if not found:
                raise ValueError("a repeat that can't be read")
            self._take(len(found[0]))
            least = int(found[1] or 0)
            most = least if not found[2] else int(found[3]) if found[3] else None
        if (least, most) != (1, 1) and self._peek() in ("?", "+"):
            self._take()  # how it is searched for doesn't matter
        return *atom, least, most


def _strings(node: tuple) -> list[str] | None:
    """All strings that a node stands for (in lower case), if they are few."""
    kind, value, least, most = node
    if kind == "one":
        one = sorted({c.lower() for c in value}) if value is not None and len(value) <= 8 else None
    else:
        parts = [_listed(x) for x in value]
        one = None if None in parts else sorted({s for x in parts for s in x})
    if one is None or most is None or most > 4:
        return None
    out, power = [], [""]
    for n in range(most + 1):
        out += power if n >= least else []
        power = [x + y for x in power for y in one]
        if len(power) > _LISTED:
            return None
    return sorted(set(out))


def _listed(nodes: list[tuple]) -> list[str] | None:
    out = [""]
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > _LISTED:
            return None
        out = [x + y for x in out for y in part]
    return out


def _query(nodes: list[tuple]) -> Query:
    """Parts with few strings are joined as long as they are; what stands
    between them ends a run of strings."""
    parts, run = [], [""]

    def close() -> None:
        parts.append(_either([[trigrams(s)] for s in run]))

    for node in nodes:
        strings = _strings(node)
        if strings is not None and len(run) * len(strings) <= _LISTED:
            run = [x + y for x in run for y in strings]
            continue
        close()
        run = [""]
        kind, value, least, _ = node
        if kind == "group" and least >= 1:
            parts.append(_either([_query(x) for x in value]))
    close()
    return _all(parts)


def trigram_query(pattern: str) -> Query:
    """Trigrams (in lower case) that a match of the expression must contain."""
    return _either([_query(x) for x in _Parser(pattern).parse()])


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """gram, id: the inverted index of the trigrams that queries ask for."""
    low = F.lower("text").alias("low")
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.col("low").contains(g))
    return texts.where("id is not null").select("id", low).select("id", F.explode(held).alias("gram")).select("gram", "id")


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """id, kinds: the rules whose query a document's postings satisfy; rules
    without mandatory trigrams aren't among them."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANY}
    wanted = [(r, k, g, len(s)) for r, q in queries.items() for k, s in enumerate(q) for g in sorted(s)]
    if not wanted:
        return None
    names = ("kind", "alternative", "gram", "need")
    asked = texts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, w)]) for w in wanted])))
    asked = F.broadcast(asked)  # as large as the rules
    met = postings(texts, sorted({g for _, _, g, _ in wanted})).join(asked, "gram")
    # Rows that repeat an id repeat its postings.
    counted = met.groupBy("id", "kind", "alternative", "need").agg(F.collect_set("gram").alias("grams"))
    return counted.where(F.size("grams") == F.col("need")).groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What comes of 0 and the values before each element.  Blocks of 256 come
    first, so the work stays near the length for very many elements."""
    every = lambda xs: F.aggregate(xs, F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 256).cast("int")), lambda b: every(F.slice(values, b * 256 + 1, F.lit(256))))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(add(F.element_at(s, -1), x))))
    at = lambda i: F.get(before, F.floor(i / 256).cast("int"))
    return F.transform(values, lambda _, i: add(at(i), every(F.slice(values, i - i % 256 + 1, i % 256))))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches."""
    # Runs of one class that are too short never stay, whatever is around them.
    java = _least(rule) if rule.group == 0 else rule.java
    pattern = F.lit(java)
    between = F.transform(F.split(text, java), F.length)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    both = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda a, b: F.coalesce(a, F.lit(0)) + b)
    rows = F.transform(F.arrays_zip(_running(both, lambda x, y: x + y).alias("before"), both.alias("both"), found.alias("chars"), sized.alias("sized")), lambda x: F.struct((x["before"] + x["both"] - x["chars"]).alias("start"), F.lit(order).alias("order"), (x["before"] + x["both"]).alias("end"), F.lit(rule.kind).alias("kind"), x["sized"].alias("sized")))
    kept = F.filter(rows, lambda x: x["sized"] >= rule.least_chars)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = BASE + ADDED, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, text, spans (by start, then the rules' order) of every row.

    carry: columns of docs that come along in a struct named ``row``.
    """
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None)
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col), rest.alias("row")).withColumn("text", F.coalesce("text", F.lit("")))
    found = candidates(rows.select("id", "text"), rules)
    if found is None:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    else:
        rows = rows.join(found.withColumnRenamed("id", "of").hint("merge"), F.col("id") == F.col("of"), "left").drop("of")
    none = F.array().cast(SPANS)
    parts = []
    for order, rule in enumerate(rules):
        if trigram_query(rule.pattern) == ANY:
            # Only runs that are long enough can stay: most texts are read once.
            asked = F.col("text").rlike(_least(rule))
        else:
            asked = F.col("id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        parts.append(F.when(asked, spans(F.col("text"), rule, order)).otherwise(none).cast(SPANS))
    every = F.array_sort(F.concat(*parts)).alias("spans")
    return rows.select(F.col("id").alias(id_col), "text", every, *(["row"] if carry else []))


_ONE_CLASS = re.compile(r"(\[[^\]\\]+\])\+")


def _least(rule: Rule) -> str:
    """For one repeated class, the expression of the matches that stay."""
    one = _ONE_CLASS.fullmatch(rule.pattern)
    return ("(?i)" if rule.any_case else "") + (f"{one[1]}{{{rule.least_chars},}}" if one and rule.least_chars else rule.pattern)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of these kinds, by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with a mark in place of each span, or of what it has beyond the
    spans before it; spans come by start."""
    ends = F.transform(spans, lambda s: s["end"])
    reached = F.arrays_zip(spans.alias("span"), _running(ends, lambda x, y: F.greatest(x, y)).alias("before"))
    kept = F.filter(reached, lambda x: x["span"]["end"] > x["before"])
    parts = F.transform(kept, lambda x: F.concat(F.substring(text, x["before"] + 1, F.greatest(x["span"]["start"] - x["before"], F.lit(0))), F.lit(mark)))
    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(parts, ""), rest))
