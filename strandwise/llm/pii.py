"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import join_counted, materialize, ship

KINDS = ("email", "ip", "card", "phone")

# The base patterns. An email is found from its @ instead, see emails().
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_MARK = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"[+(]{0,2}[0-9]+(?:[ \t\xa0()./-]{1,3}[0-9]+)*")
_BLANK = re.compile(r"[ \t\xa0]")
_TRIM = "\"'`.,;:!?()[]{}<>|*#%$&="
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain. Each @ is taken with the run of local characters before it, so a text costs its length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start. A match that fails its test is dropped, without a retry."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(n := _digits(m[0])) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, taken: list[tuple[str, int, int]], least: int = 6) -> list[tuple[int, int]]:
    """Words with a digit or an @, trimmed of marks, and runs of digit groups joined by blanks, brackets, dots, hyphens and slashes over several words, of at least ``least`` characters, that touch no base span."""
    out, at = [], 0
    spans = sorted((a, b) for _, a, b in taken)
    k = 0
    while m := _MARK.search(text, at):
        start = end = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        n = len(text)
        while end < n and not text[end].isspace():
            end += 1
        at = end
        a, b = start, end
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if b - a >= least and not any(s < b and e > a for s, e in spans[k : k + 4]):
            out.append((a, b))
    from_ = 0
    for s, e in [*spans, (len(text), len(text))]:
        for m in _GROUPS.finditer(text, from_, max(from_, s)):
            a, b = m.span()
            if "(" in m[0][:2] and ")" not in m[0]:
                a += m[0].index("(") + 1
            if b - a >= least and _BLANK.search(text, a, b):
                out.append((a, b))
        from_ = max(from_, e)
    return sorted(set(out))


def shape(value: str) -> str:
    """The value with each digit as 0 and each run of letters as a."""
    return _DIGIT.sub("0", _LETTERS.sub("a", value))


def contexts(text: str, start: int, end: int, low: int = 0, high: int | None = None) -> list[str]:
    """The lexical patterns of a span, from general to narrow; their first letter is their level. s: the value's shape, that with runs of digits as one, and that with the marks around it;
    l and r: the collapsed shape with the word before or after; w: the two words before; b: the word before and the word after. Words count in full, in lower case, digits as 0;
    they are looked for from ``low`` to ``high``, the ends of the neighbouring spans, beyond which ``<>`` stands for the neighbour."""
    high = len(text) if high is None else high
    before = _DIGIT.sub("0", " ".join(text[low:start].rsplit(None, 2)[-2:]).lower()).split()
    after = _DIGIT.sub("0", " ".join(text[end:high].split(None, 1)[:1]).lower()).split()
    edge = "<>" if low else "^"
    one = before[-1] if before else edge
    two = before[-2] if len(before) > 1 else edge if before else "^"
    right = after[0] if after else "<>" if high < len(text) else "$"
    full = shape(text[start:end])
    small = re.sub("0+", "0", full)
    marks = "".join("" if c.isspace() or c.isalnum() else c for c in (text[start - 1 : start], "_", text[end : end + 1]))
    return list(dict.fromkeys([f"s{full}", f"s~{small}", f"s{marks}{full}", f"l{one} {small}", f"r{small} {right}", f"w{two} {one} _", f"b{one} _ {right}"]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, row (unique), base spans, and all spans with their value and patterns: those of base kinds, and candidates (kind null)."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    seen_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                batch = big.slice(i, 1000)
                base, seen = [], []
                for t in batch.column(2):
                    text = t.as_py() or ""
                    spans = base_spans(text)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    every = spans + [(None, a, b) for a, b in candidates(text, spans)]
                    begins, ends = sorted(a for _, a, _ in every), sorted(b for _, _, b in every)
                    found = []
                    for k, a, b in every:
                        i, j = bisect.bisect_right(ends, a), bisect.bisect_left(begins, b)
                        near = contexts(text, a, b, ends[i - 1] if i else 0, begins[j] if j < len(begins) else len(text))
                        found.append({"kind": k, "start": a, "end": b, "value": text[a:b].lower(), "patterns": near})
                    seen.append(found)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(base, base_type), pa.array(seen, seen_type)], names=["id", "row", "base", "seen"])

    source = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, row long, base array<struct<kind:string,start:int,end:int>>, seen array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>>>"
    return materialize(source.mapInArrow(run, schema), "pii-scan")


def known(scanned: DataFrame, rounds: int | None = None, least_support: int = 4, least_share: float = 0.4, least_score: float = 0.65, hidden: str | None = None) -> DataFrame:
    """(kind, value, score, seed) of the seeds (score 1) and of the identifiers that their patterns bring in.

    The graph has an edge for each distinct pattern and value that meet; seeds are the values of base spans (of one that has two kinds, the first by name). In each round a pattern's confidence in a kind is the share of its
    values known to be of that kind, seeds and those found before, each by its score, shrunk by one unknown value; it counts from ``least_support`` known values and ``least_share`` on. A value's score is
    one minus the product of its doubts, one doubt for each level of pattern: that of its most confident one. Values from ``least_score`` on join the seeds of their best kind, with the score they join with, for the rounds to come.
    Rounds go on until one adds no value, or for ``rounds``. ``hidden``, a condition on kind and value, takes seeds away, to measure how many come back.
    """
    flat = scanned.select(F.explode("seen").alias("s")).select("s.kind", "s.value", F.explode("s.patterns").alias("pattern"))
    edges = materialize(flat.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-edges")
    base = edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    base = materialize((base.filter(f"not ({hidden})") if hidden else base).select("kind", "value", "score"), "pii-seeds")
    marked = edges.select("pattern", "value").join(base.select("kind", "value"), "value", "left")
    # a pattern of fewer values never has the support, one without unknown values finds none
    totals = marked.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"), F.count("kind").alias("seeds")).filter((F.col("total") >= least_support) & (F.col("total") > F.col("seeds"))).select("pattern", "total")
    totals = materialize(totals.withColumn("rows", F.col("total")), "pii-totals")
    n = edges.count()
    live = materialize(join_counted(marked, totals, "pattern", "rows", n), "pii-live")

    def hits(known: DataFrame) -> DataFrame:
        return live.select("pattern", "value", "total").join(known.select("value", "kind", "score"), "value").groupBy("pattern", "kind", "total").agg(F.sum("score").alias("hits"))

    found, support, done = base.withColumn("seed", F.lit(True)), materialize(hits(base), "pii-support"), 0
    while rounds is None or done < rounds:
        confident = support.withColumn("confidence", F.col("hits") / (F.col("total") + 1)).filter((F.col("hits") >= least_support) & (F.col("confidence") >= least_share))
        confident = materialize(confident.groupBy("pattern", "total").agg(F.collect_list(F.struct("kind", "confidence")).alias("kinds")), "pii-confident")
        met = join_counted(live.filter("kind is null").select("pattern", "value"), confident, "pattern", "total", n)
        levels = met.select("pattern", "value", F.inline("kinds").alias("kind", "c")).groupBy("value", "kind", F.substring("pattern", 1, 1).alias("level")).agg(F.max("c").alias("c"))
        scored = levels.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("c"), F.lit(0.999)))))).alias("score"))
        best = scored.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b")).filter(F.col("b.score") >= least_score)
        new = materialize(best.select("b.kind", "value", "b.score").join(found.select("value"), "value", "left_anti").select("kind", "value", "score", F.lit(False).alias("seed")), "pii-new")
        if new.isEmpty():
            break
        found = materialize(found.unionByName(new), "pii-found")
        support = materialize(support.unionByName(hits(new)).groupBy("pattern", "kind", "total").agg(F.sum("hits").alias("hits")), "pii-support")
        done += 1
    return found


def bootstrap(scanned: DataFrame, rounds: int | None = None, **settings) -> DataFrame:
    """(kind, value, score) of the identifiers that ``known`` adds to its seeds."""
    return known(scanned, rounds, **settings).filter("not seed").drop("seed")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """Per row of ``docs``: id, base spans and all spans (base ones and occurrences of discovered identifiers), each an array of (kind, start, end).

    A seed's value that stands elsewhere out of a base span (in a longer run that failed its test) is found there too. A null text is empty. Equal texts get equal spans. Repeated rows and ids stay rows of their own; other columns are not read.
    """
    scanned = scan(docs, id_col, text_col)
    found = known(scanned, rounds)
    order = F.expr("array_position(array('email', 'ip', 'card', 'phone'), kind)")
    places = scanned.select("row", F.explode("seen").alias("s")).filter("s.kind is null").select("row", "s.start", "s.end", "s.value").join(found.select("kind", "value"), "value")
    extra = places.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(order.alias("rank"), "start", "kind", "end"))).alias("more"))
    rows = scanned.select("id", "row", "base").join(extra, "row", "left")
    ranked = "transform(base, b -> struct(array_position(array('email', 'ip', 'card', 'phone'), b.kind) as rank, b.start as start, b.kind as kind, b.end as end))"
    every = F.expr(f"if(more is null, base, transform(array_sort(concat({ranked}, more)), x -> struct(x.kind as kind, x.start as start, x.end as end)))")
    return rows.select(F.col("id").alias(id_col), "base", every.alias("spans"))


def _text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find`` as counts of the base spans by kind, their digest, and all spans as text."""
    rows = find(docs, id_col, text_col)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return rows.select(id_col, *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; where spans overlap, the first is replaced."""
    if text is None:
        return None
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
            last = b
    return "".join([*out, text[last:]])
