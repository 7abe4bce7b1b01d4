"""Personal data: fixed base detectors plus bootstrapped contextual extraction.

The base detectors find e-mail addresses, IP addresses, card and phone numbers.
Their finds and values shaped like keys (kind ``secret``, always added) are the
seeds of a bootstrap: the words around a find and the name before ``=`` or ``:``
in its own word are lexical patterns, every identifier-shaped token of the corpus is a possible instance, and
Spark scores the bipartite pattern-instance graph iteratively.  A pattern is
trusted as far as its distinct instances are known members of a kind; an
instance is accepted when the trusted patterns it stands in, taken together,
leave little doubt.  Accepted instances in trusted patterns add spans; base spans
always stay.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise

KINDS = ("email", "ip", "card", "phone")
#: The kind of spans beyond the base: passwords, tokens and keys.
SECRET = "secret"
ROUNDS = 3
#: Distinct instances of a pattern, at least; its share of known members; and the doubt left about an accepted instance.
MIN_INSTANCES, MIN_PATTERN, MIN_INSTANCE = 5, 0.8, 0.8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
#: Seeds of secrets: access key ids, and hexadecimal values of 16 digits or more with letters among them.
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,}")
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind, then start: leftmost matches that don't overlap within their kind; those that fail their check are dropped."""
    if not text:
        return []
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):  # from the @ backwards: linear on long runs without one
            s = m.start()
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            if s < m.start():
                out.append(("email", s, m.end()))
                last = m.end()
    if not any(c in text for c in "0123456789"):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _context(words: list[tuple[int, int]], text: str, first: int, last: int) -> tuple[str, str]:
    """The words before the first and after the last of the words ``first..last``, with their marks, digits as 0; of marks alone with the word before them."""

    def norm(k: int) -> str:
        if not 0 <= k < len(words):
            return "\x02"
        word = _DIGIT.sub("0", text[words[k][0] : words[k][1]].lower())
        # a very long word is told from others by its hash
        return word if len(word) <= 40 else f"{word[:24]}#{xxhash.xxh64_hexdigest(word)}"

    left = norm(first - 1)
    if not any(c.isalnum() for c in left) and first > 1:
        left = f"{norm(first - 2)} {left}"
    return left, norm(last + 1)


def occurrences(text: str) -> list[tuple[str | None, int, int, str, str, str]]:
    """``(kind or None, start, end, value, left, right)`` of base spans, of values shaped like keys and of other identifier-shaped tokens.

    Such a token has a digit or ``@`` and at least six characters after its outer
    marks are cut, and overlaps no base span.
    """
    spans = base_spans(text)
    if not spans and "@" not in text and not any(c in text for c in "0123456789"):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    begin = np.array([w[0] for w in words], np.int64)
    out: list = []
    taken: set[int] = set()
    for kind, s, e in spans:
        a, z = int(np.searchsorted(begin, s, "right")) - 1, int(np.searchsorted(begin, e - 1, "right")) - 1
        taken.update(range(a, z + 1))
        out.append((kind, s, e, text[s:e].lower(), *_context(words, text, a, z)))
    for k, (s, e) in enumerate(words):
        if k in taken:
            continue
        word = text[s:e]
        if not ("@" in word or _DIGIT.search(word)):
            continue
        left, right = _context(words, text, k, k)
        at = max(word.rfind("="), word.rfind(":")) + 1
        if at > 1 and len(word) - at >= 6:  # a name and its value in one word
            left, s, word = word[:at].lower().lstrip(_EDGE), s + at, word[at:]
        cut = word.lstrip(_EDGE)
        s += len(word) - len(cut)
        cut = cut.rstrip(_EDGE)
        if len(cut) >= 6 and ("@" in cut or _DIGIT.search(cut)):
            out.append((SECRET if _KEY.fullmatch(cut) else None, s, s + len(cut), cut.lower(), left, right))
    return out


_OCC = "array<struct<kind:string,start:int,end:int,value:string,left:string,right:string>>"


def _scan(docs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string())]))

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(1):
                found.append([dict(zip(("kind", "start", "end", "value", "left", "right"), o, strict=True)) for o in occurrences(t.as_py() or "")])
            row = np.frombuffer(os.urandom(8 * b.num_rows), np.int64)  # tells rows of one id apart; fixed once written
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(row), pa.array(found, kind)], names=["doc_id", "row", "occ"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, run, f"doc_id long, row long, occ {_OCC}")


def _patterns():
    return F.array(F.concat(F.lit("l "), "left"), F.concat(F.lit("r "), "right"), F.concat(F.lit("b "), F.col("left"), F.lit(" "), F.col("right")))


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(pattern, value, kind)``: accepted instances, each with the trusted patterns it stands in.

    ``found(kind, value, left, right)`` has a row an occurrence; ``kind`` is null
    where no base detector knows it.
    """
    edges = materialise(found.select("value", F.explode(_patterns()).alias("pattern")).distinct(), "pii-edges")
    sizes = materialise(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_INSTANCES), "pii-sizes")
    edges = materialise(edges.join(sizes, "pattern"), "pii-edges")
    seeds = materialise(found.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("s")).distinct(), "pii-seeds")
    known, accepted = seeds, None
    for _ in range(rounds):
        patterns = edges.join(known, "value").groupBy("pattern", "kind").agg((F.sum("s") / F.first("n")).alias("p"))
        patterns = materialise(patterns.where(F.col("p") >= MIN_PATTERN), "pii-patterns")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p") * 0.95)))
        scored = edges.join(patterns, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("s")).where(F.col("s") >= MIN_INSTANCE)
        # one kind a value: the surest, then the first by name; values that a base detector knows are settled
        best = scored.groupBy("value").agg(F.max_by(F.struct("kind", "s"), F.struct("s", "kind")).alias("b")).select("value", "b.kind", "b.s")
        accepted = materialise(best.join(seeds.select("value").distinct(), "value", "left_anti"), "pii-new")
        known = seeds.unionByName(accepted)
    return edges.select("pattern", "value").join(accepted.select("value", "kind"), "value").join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select("pattern", "value", "kind")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, spans, added)`` for every row of ``docs``: base spans and added ones, arrays of ``(kind, start, end)``.

    Offsets are code points, ends exclusive; ``ordered`` sorts by kind (as in
    ``KINDS``, then ``secret``), then start.  Null texts are empty; texts of any
    length are read whole; repeated rows and null ids keep a row each; extra columns are ignored; an empty table gives no rows.
    """
    scan = materialise(_scan(docs), "pii-scan")
    flat = scan.where(F.size("occ") > 0).select("row", F.explode("occ").alias("o")).select("row", "o.*")
    accepted = bootstrap(flat, rounds).withColumnRenamed("kind", "as_kind")
    met = flat.where("kind IS NULL").select("row", "start", "end", "value", F.explode(_patterns()).alias("pattern")).join(accepted, ["pattern", "value"])
    seeds = flat.where(F.col("kind") == SECRET).select("row", F.struct("kind", "start", "end").alias("span"))
    new = met.select("row", F.struct(F.col("as_kind").alias("kind"), "start", "end").alias("span")).unionByName(seeds)
    new = materialise(new.groupBy("row").agg(F.collect_set("span").alias("added")), "pii-added")  # bounded by one document's tokens
    base = F.transform(F.filter("occ", lambda o: o["kind"].isin(*KINDS)), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    out = scan.join(new, "row", "left")
    return out.select("doc_id", base.alias("spans"), F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def ordered(spans):
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    place = F.create_map(*[x for k, v in enumerate((*KINDS, SECRET)) for x in (F.lit(v), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.element_at(place, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
