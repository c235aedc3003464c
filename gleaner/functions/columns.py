"""Column expressions: vectors, paths, names, scores, JSON.  All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default noise patterns of paths.
NOISE_PATTERNS = ("docs/diffs/*", "*.json", ".history/*", ".lh/*", ".venv/*", "node_modules/*", "__pycache__/*", "dist/*", "build/*", ".git/*")
# Entity types that stand for code, and tokens of such types.
CODE_TYPES = ("MODULE", "COMPONENT", "METHOD", "FUNCTION", "CLASS", "INSIGHT_ENGINE", "KNOWLEDGE_GRAPH", "EXTRACTION_PIPELINE", "REASONING_STRATEGY", "ONTOLOGY")
# Failures of calls that pass by themselves.
PASSING_STATUS = (429, 500, 502, 503, 504)
PASSING_KINDS = ("timeout", "connect", "read")
CODE_TOKENS = ("MODULE", "COMPONENT", "METHOD", "FUNCTION", "CLASS", "ENGINE", "PIPELINE", "ALGORITHM")
#: White space at the ends, as Python's strip sees it.
ENDS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(ENDS))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it reads several times but that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    parts = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def path_distance(a: Column, b: Column) -> Column:
    """1 less the share of leading parts that two paths have in common."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    x, y = parts(a), parts(b)
    longest = F.greatest(F.size(x), F.size(y))
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return F.when(longest == 0, F.lit(0.0)).otherwise(1.0 - shared / longest)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def noisy(path: Column, patterns: tuple[str, ...] = NOISE_PATTERNS) -> Column:
    """Whether a whole path fits a glob pattern; a star crosses slashes."""
    quoted = ["".join({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() else c) for c in p) for p in patterns]
    return path.rlike("(?s)^(" + "|".join(quoted) + ")$") if quoted else F.lit(False)


def code_like(kind: Column) -> Column:
    return F.coalesce(kind.isin(*CODE_TYPES) | kind.rlike("|".join(CODE_TOKENS)), F.lit(False))


def gap_kept(kind: Column, incoming: Column, mentions: Column) -> Column:
    """Types of code need a wide gap and few mentions, all others pass."""
    return ~code_like(kind) | ((incoming - mentions >= 5) & (mentions <= 2))


def gap_score(incoming: Column, mentions: Column) -> Column:
    return F.least(0.6 + 0.4 * (incoming - mentions) / F.greatest(incoming, F.lit(1)), F.lit(1.0))


def bridge_score(similarity: Column, distance: Column, mean_length: Column) -> Column:
    return similarity * (0.5 + 0.5 * distance) * (0.6 + 0.4 * F.least(mean_length / 400, F.lit(1.0)))


def entity_bridge_score(distance: Column, mentions: Column) -> Column:
    return 0.7 * (0.5 + 0.5 * distance) * (0.5 + 0.5 * F.least(mentions / 10, F.lit(1.0)))


def content_id(*parts: Column, length: int = 20) -> Column:
    """Leading hex digits of a SHA-256 over the parts, joined by colons."""
    return F.left(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(length))


def entity_id(corpus: Column, kind: Column, name: Column) -> Column:
    return content_id(corpus, kind, stripped(F.lower(name)))


def type_name(raw: Column) -> Column:
    """A name of A-Z, 0-9 and _ that begins with a letter; null if none is left."""
    # Most names need no more than this.
    text = F.translate(F.upper(raw), " -", "__")
    bare = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^A-Z0-9_]", ""), "_+", "_"), "^_|_$", "")
    named = lambda t: F.when(t == "", F.lit(None)).when(t.rlike("^[0-9]"), F.concat(F.lit("REL_"), t)).otherwise(t)
    return once(text, lambda t: F.when(t.rlike(r"\A[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\z"), t).otherwise(once(bare(t), named)))


def lenient_json(text: Column) -> Column:
    """The first that parses: the whole, a fenced block, the widest {...} or
    [...]; null if none does."""
    tried = [text, F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.try_parse_json(F.when(t != "", t)) for t in tried])


def uct(total: Column, visits: Column, parent_visits: Column, c: float = 1.41) -> Column:
    """Infinite for what hasn't been visited."""
    safe = F.greatest(visits, F.lit(1))
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(total / safe + c * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1))) / safe))


def arm_name(strategy: Column) -> Column:
    return F.regexp_replace(strategy, "_(discovery|detection)", "")


def escaped_query(text: Column) -> Column:
    """A text query with the special characters of the query syntax escaped, for
    stores that have one; search.bm25 takes plain words."""
    return F.regexp_replace(text, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")


def embedding_text(text: Column) -> Column:
    return F.when(stripped(F.coalesce(text, F.lit(""))) == "", F.lit(" ")).otherwise(text)


def entity_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), description)


def hop(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -["), kind, F.lit("]-> "), target)


def hash_order(seed: int, key: Column) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def last_n(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def transient(status: Column, kind: Column) -> Column:
    """Whether a failed call is worth another try."""
    return F.coalesce(status.isin(*PASSING_STATUS), F.lit(False)) | F.coalesce(kind.isin(*PASSING_KINDS), F.lit(False))


def shortened(text: Column, n: int) -> Column:
    """The first n characters, as reports and prompts hold them; null is empty."""
    return F.left(F.coalesce(text, F.lit("")), F.lit(n))


def contradicted(layer: Column, verdict: Column, confidence: Column) -> Column:
    """Whether a finding of the first layer goes, since its source refutes it."""
    return F.coalesce((layer == 1) & (verdict == "contradict") & (confidence >= 0.7), F.lit(False))


def tokens(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda x: x != "")
