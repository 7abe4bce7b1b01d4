"""Benchmark decontamination by template canonicalisation.

Every text is canonicalised to a template: numbers, names and units of measure
become typed placeholders, other words are lower-cased.  Windows of ``width``
template tokens are hashed and hash-joined with the benchmark's windows.  A
document is contaminated by an item when at least ``share`` of the item's
distinct windows occur in it and the placeholders are filled consistently: each
value of the item always meets one value of the document and the other way
round, so the same question with other numbers, names or units is caught, while
unrelated text that merely has the same shape is not.  Where a window occurs
several times, every alignment of item and document is tried.  A capitalised word
that begins a sentence may be a name or not: it is read both ways.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard_since, map_batches, materialise, written

WIDTH = 5
SHARE = 0.5
#: Benchmark windows (8 bytes each) that one block holds, at most.
BLOCK = 4_000_000
#: Tokens of an item that may stand anywhere in a document; shorter ones count where they are all of it.
LEAST = 3

#: Units that become a typed placeholder after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons oz ounce ounces pound pounds lb lbs ml l liter liters litre litres "
    "gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent degree degrees mph kmh kwh watt watts volt volts".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n:;\"“”|%$€£°]")
_END = frozenset('.!?\n:;"“”|')
_SIGN, _CURRENCY = frozenset("%$€£°"), frozenset("$€£")
#: The unit that a sign or an irregular plural stands for.
_WORDS = {"%": "percent", "$": "dollar", "€": "euro", "£": "pound", "°": "degree", "feet": "foot", "inches": "inch"}
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def _unit(word: str) -> str:
    """One form of a unit: singular; the word for a sign."""
    word = _WORDS.get(word, word)
    return word[:-1] if word.endswith("s") and word[:-1] in UNITS else word


def template(text: str | None) -> tuple[list[str], list[str | None], list[int]]:
    """Template tokens, beside each the value that its placeholder stands for (None for plain words), and the places of words that may be names.

    A number is digits with inner points or commas; a unit is a known unit word
    or sign right after a number, or a currency sign right before it (it then
    follows its number in the template, so that "$9" and "9 dollars" are one); a
    name is a capitalised word with lower-case letters that does not begin a
    sentence or line; one that does is a plain word that may be a name.
    """
    out: list[str] = []
    values: list[str | None] = []
    heads: list[int] = []
    begins, number, sign = True, False, ""
    for tok in _TOKEN.findall(text or ""):
        if tok in _END:
            begins, number, sign = True, False, ""
            continue
        if tok in _SIGN:
            if number:
                out.append(UNIT)
                values.append(_unit(tok))
            sign = tok if not number and tok in _CURRENCY else ""
            number = False
            continue
        low = tok.lower()
        if tok[0].isdigit():
            out.append(NUM)
            values.append(tok)
            if sign:
                out.append(UNIT)
                values.append(_unit(sign))
            number, begins, sign = not sign, False, ""
            continue
        if number and low in UNITS:
            out.append(UNIT)
            values.append(_unit(low))
        elif tok[0].isupper() and not tok.isupper() and len(tok) > 1:
            if begins:
                heads.append(len(out))
            out.append(low if begins else NAME)
            values.append(None if begins else low)
        else:
            out.append(low)
            values.append(None)
        number, begins, sign = False, False, ""
    return out, values, heads


#: Kinds of characters in the low bits of their class; the other bits: joins digits or letters, capital, breaks capitals, ``_odd``.
_DIGIT, _LETTER, _ENDS, _SIGNS, _MONEY = 1, 2, 3, 4, 5
_KIND, _IN_NUM, _IN_WORD, _UPPER, _LOWER, _ODD, _UNKNOWN = 7, 8, 16, 32, 64, 128, 255
#: For each code point its class and the hash of its lower case, filled in when it first occurs.
_CLASS = np.full(0x110000, _UNKNOWN, np.uint8)
_MIX = np.zeros(0x110000, np.uint64)
#: Letters of a token that is hashed with others; single ones beyond that are hashed by themselves.
_LONG = 64
#: Characters that are classified at once, about at most.
_PIECE = 150_000
#: A piece may end behind such a character, no token goes on over it.
_CUT = re.compile(r"[^\w.,'’]")
_MASK, _FACTOR, _LAST = (1 << 64) - 1, 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


def _mix(point: int) -> int:
    return xxhash.xxh64_intdigest(point.to_bytes(4, "little"), 11)


def _code(token: str) -> int:
    """The hash of a template token: a polynomial of its code points' hashes."""
    if len(token) > _LONG:
        return xxhash.xxh64_intdigest(token, 11)
    h = 0
    for c in reversed(token):
        h = (h * _FACTOR + _mix(ord(c))) & _MASK
    h = (h ^ h >> 32) * _LAST & _MASK
    return h ^ h >> 29


_NUM_CODE, _UNIT_CODE, _NAME_CODE = (np.uint64(_code(x)) for x in (NUM, UNIT, NAME))
_UNIT_WORDS = np.array(sorted(_code(x) for x in UNITS), np.uint64)


def _odd(char: str) -> bool:
    """A letter that ``template`` reads as a digit, or whose lower case is longer or depends on its place."""
    return char.isdigit() or len(char.lower()) > 1 or char == "Σ"


def _learn(points: list[int]) -> None:
    for p in points:
        c = chr(p)
        if c.isdecimal():
            x = _DIGIT
        elif c.isalnum():
            x = _LETTER | (_ODD if _odd(c) else 0)
        else:
            x = _ENDS if c in _END else _MONEY if c in _CURRENCY else _SIGNS if c in _SIGN else 0
        x |= _IN_NUM if c in ".," else _IN_WORD if c in "'’" else 0
        x |= _UPPER if c.isupper() else _LOWER if c.islower() or c.istitle() else 0
        _CLASS[p], _MIX[p] = x, _mix(ord(c.lower()[0]))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse; those of a piece are kept."""
    if n <= 2 * _PIECE:
        if not _powers:
            _powers[0] = _raised(2 * _PIECE)
        up, down = _powers[0]
        return up[:n], down[:n]
    return _raised(n)


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[:1] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


def _scan(text: str, cache: dict[str, int]) -> tuple[np.ndarray, ...]:
    """What ``_TOKEN`` finds: each token's place, kind, whether it is written like a name, and the code of its lower case."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
    c = _CLASS[a]
    unknown = c == _UNKNOWN
    if unknown.any():
        _learn(np.unique(a[unknown]).tolist())
        c = _CLASS[a]
    kind = c & _KIND
    for joins, what in ((_IN_NUM, _DIGIT), (_IN_WORD, _LETTER)):
        k = np.flatnonzero(c[1:-1] & joins) + 1
        kind[k[(kind[k - 1] == what) & (kind[k + 1] == what)]] = what
    new = kind >= _ENDS  # each is a token
    new[:1] = True
    new[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(a))[: len(start)]
    token = kind[start] > 0
    start, last = start[token], end[token] - 1
    kind = kind[start]
    lower = np.cumsum(c & _LOWER > 0, dtype=np.int32)
    name = (c[start] & _UPPER > 0) & (lower[last] > lower[start])
    up, down = _factors(len(a))
    h = _MIX[a]
    h *= up
    before = h[start]
    np.cumsum(h, out=h)
    code = (h[last] - h[start] + before) * down[start]
    code = (code ^ code >> np.uint64(32)) * np.uint64(_LAST)
    code ^= code >> np.uint64(29)
    alone = (last - start >= _LONG) & (kind == _LETTER)
    alone[np.searchsorted(start, np.flatnonzero(c & _ODD), "right") - 1] = True
    for k in np.flatnonzero(alone).tolist():
        tok = text[start[k] : last[k] + 1]
        if tok[0].isdigit():
            kind[k] = _DIGIT
            continue
        found = cache.get(tok)
        if found is None:
            found = _code(tok.lower())
            if len(cache) > 50_000:
                cache.clear()
            if len(tok) < 200:
                cache[tok] = found
        code[k] = found
    return start, kind, name, code


def _tokens(text: str, cache: dict[str, int]) -> tuple[np.ndarray, ...]:
    """``_scan`` of a text of any length, piece by piece."""
    parts, at = [], 0
    while at < len(text) or not parts:
        cut = _CUT.search(text, at + _PIECE) if len(text) - at > 2 * _PIECE else None
        to = cut.end() if cut else len(text)
        start, *more = _scan(text[at:to], cache)
        parts.append((start + at, *more))
        at = to
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def template_codes(text: str | None, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of ``template`` and the places of words that may be names, without the values."""
    _, *found = _tokens(text or "", cache)
    codes, keep, head = _classify(*found)
    return codes[keep], np.flatnonzero(head[keep])


def _classify(kind: np.ndarray, name: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its code, whether it is in the template and whether it may be a name."""
    number, word, sign = kind == _DIGIT, kind == _LETTER, (kind == _SIGNS) | (kind == _MONEY)
    behind = np.append(False, number)[:-1]  # behind a number
    # a number takes a currency sign right before it, unless that is the unit of the number before; in "$5$6" and "5$6$7" all go as the first
    money = np.flatnonzero(kind == _MONEY)
    first = np.append(True, (np.diff(money) > 2) | ~behind[money[1:]])[: len(money)]
    of_before = behind[money][np.flatnonzero(first)][np.cumsum(first) - 1]
    taken = money[~of_before & np.append(number, False)[money + 1]]
    free = np.ones(len(kind) + 1, bool)
    free[taken + 2] = False  # the token after such a number: it has its unit
    behind &= free[:-1]
    # words begin a sentence where the last token but signs ends one
    real = np.flatnonzero(~sign)
    begins = np.zeros(len(kind), bool)
    begins[real] = np.append(True, kind[real] == _ENDS)[: len(real)]
    is_unit = word & behind
    k = np.flatnonzero(is_unit)
    is_unit[k] = np.isin(code[k], _UNIT_WORDS)
    unit_sign = sign & behind
    name = word & name & ~is_unit
    head = name & begins
    out = code.copy()
    out[number] = _NUM_CODE
    out[is_unit | unit_sign] = _UNIT_CODE
    out[name & ~begins] = _NAME_CODE
    out[taken], out[taken + 1] = _NUM_CODE, _UNIT_CODE  # the sign's place goes to the number
    keep = number | word | unit_sign
    keep[taken] = True
    return out, keep, head


def _together(texts: list[str | None], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``template_codes`` of several texts, one after the other: codes, whether each may be a name, and each text's first place (and the end)."""
    texts = [t or "" for t in texts]
    start, *found = _tokens("\n".join([*texts, ""]), cache)
    codes, keep, head = _classify(*found)
    ends = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return codes[keep], head[keep], np.append(0, np.cumsum(keep))[ends]


def window_hashes(tokens: list[str], width: int, cache: dict[str, int] | None = None) -> np.ndarray:
    """Signed 64-bit hashes of all windows; fewer tokens than ``width`` make one window, none make none."""
    return _hashes(_codes(tokens, cache), min(width, len(tokens)))


def _codes(tokens: list[str], cache: dict[str, int] | None = None) -> np.ndarray:
    cache = {} if cache is None else cache
    codes = list(map(cache.get, tokens))
    if None in codes:
        if len(cache) > 500_000:
            cache.clear()
        for k, c in enumerate(codes):
            if c is None:
                codes[k] = cache[tokens[k]] = xxhash.xxh64_intdigest(tokens[k], 11)
    return np.array(codes, np.uint64)


def _hashes(a: np.ndarray, width: int) -> np.ndarray:
    """Signed hashes of all windows of ``width`` codes."""
    if not 0 < width <= len(a):
        return np.empty(0, np.int64)
    h = np.full(len(a) - width + 1, width, np.uint64)
    for k in range(width):
        h = (h ^ a[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


_ROWS = "id long, h long, at int, slots string, key long, named int, n int, total int"


def _windows(df: DataFrame, id_col: str, text_col: str, width: int, block=None, widths: tuple[int, ...] = ()) -> DataFrame:
    """``(id, h, at, slots, key, named, n, total)`` for each window of each row, or only those whose hash is in ``block`` (sorted, broadcast).

    Without a block a text shorter than ``width`` is a single window; with one,
    windows of all ``widths`` are looked up.  A window with words that may be
    names comes twice: as plain words, and with ``named`` 1 as names.  ``key`` is
    its hash as plain words, ``n`` its tokens and ``total`` those of the text.
    """

    def run(batches):
        keep = block.value if block is not None else None
        cache: dict[str, int] = {}
        if keep is not None:
            bits = min(24, (16 * len(keep)).bit_length())
            shift, there = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            there[keep.view(np.uint64) >> shift] = True

        def add(rows, ids, texts) -> None:
            codes, head, first = _together(texts, cache)
            named = np.where(head, _NAME_CODE, codes)
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            hits: dict[int, list[tuple]] = {}
            # without a block there is one text
            for w in widths if keep is not None else (min(width, len(codes)),):
                plain, other = _hashes(codes, w), _hashes(named, w)
                if not len(plain):
                    continue
                inside = doc[: len(plain)] == doc[w - 1 :]
                for kind, h in ((0, plain), (1, other)):
                    fits = inside if kind == 0 else inside & (other != plain)
                    if keep is not None:
                        fits = fits & there[h.view(np.uint64) >> shift]  # few windows are left to look up
                    at = np.flatnonzero(fits)
                    if keep is not None:
                        at = at[keep[np.minimum(np.searchsorted(keep, h[at]), len(keep) - 1)] == h[at]]
                    for k in at.tolist():
                        hits.setdefault(int(doc[k]), []).append((w, kind, k, int(h[k]), int(plain[k])))
            for d, found in hits.items():
                toks, vals, heads = template(texts[d])  # the values are wanted of few texts only
                as_name, start = set(heads), int(first[d])
                for w, kind, k, h, key in found:
                    slots = [toks[x] if kind and x in as_name else vals[x] for x in range(k - start, k - start + w)]
                    row = (ids[d], h, k - start, "\x1f".join(v for v in slots if v is not None), key, kind, w, len(toks))
                    for column, x in zip(rows, row, strict=True):
                        column.append(x)

        for b in batches:
            rows: list[list] = [[] for _ in range(8)]
            ids, texts, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if keep is None or size > 150_000:
                    add(rows, ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                add(rows, ids, texts)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["id", "h", "at", "slots", "key", "named", "n", "total"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).transform(map_batches, run, _ROWS)


def _aligned(chosen) -> tuple[set[int], bool] | None:
    """The windows of an alignment and whether it is verbatim; None where item and document values do not correspond one to one."""
    there, back, keys, same = {}, {}, set(), True
    for key, item, doc in chosen:
        keys.add(key)
        same = same and item == doc
        a, b = item.split("\x1f") if item else [], doc.split("\x1f") if doc else []
        if len(a) != len(b):
            return None
        for x, y in zip(a, b, strict=True):
            if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return None
    return keys, same


def _judge(matches: list[tuple[int, int, int, int, str, str]], least: float, positions: int) -> int:
    """Of the matches ``(key, item place, document place, named, item values, document values)``: 0 no contamination, 1 with other values, 2 verbatim.

    Alignments that are tried: every item window where it has the item's own
    values, else at its first occurrence; and for each offset between item and
    document that a match has, every item window at its occurrence next to that
    offset, within one passage or wherever it is.  All windows of an alignment
    must agree and make up ``least`` of the item's windows.
    """
    best = 0
    for kinds in (0, 1):  # words that may be names: first as plain words only
        places = defaultdict(dict)
        for key, p, q, named, item, doc in sorted(matches, key=lambda m: (m[1], m[2], -m[3])):
            if named <= kinds:
                places[p][q] = (key, item, doc)  # plain words come last and replace the same words read as names
        table = [(p, list(at), list(at.values())) for p, at in places.items()]
        if len({c[0] for _, _, cs in table for c in cs}) < least:
            continue
        got = _aligned(next((c for c in cs if c[1] == c[2]), cs[0]) for _, _, cs in table)
        if got and len(got[0]) >= least:
            best = max(best, 2 if got[1] else 1)
        slack = positions // 2
        for d in sorted({q - p for p, qs, _ in table for q in qs}):
            if best == 2:
                return 2
            near, far = [], []
            for p, qs, cs in table:
                k = bisect_left(qs, p + d)
                if k == len(qs) or (k and p + d - qs[k - 1] <= qs[k] - p - d):
                    k -= 1
                (near if abs(qs[k] - p - d) <= slack else far).append(cs[k])
            got = _aligned(near)
            if got and len(got[0]) < least:
                got = _aligned(near + far)
            if got and len(got[0]) >= least:
                best = max(best, 2 if got[1] else 1)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched, verbatim)``: the items found in each document.

    ``n_windows`` counts the item's distinct windows, ``n_matched`` those found;
    ``verbatim`` tells whether all slots have the item's own values.  An item with
    fewer than ``width`` tokens is a single window and counts only verbatim: with
    other values so short a template says nothing; under ``LEAST`` tokens it must
    be the whole document.  Null and empty texts contain nothing and are
    contained nowhere; rows with a null id are not judged; repeated rows of one
    id count as one; texts of any length are read whole; extra columns are
    ignored; an empty table gives no rows.

    Candidates come from the rarest windows of an item, as many as leave fewer
    than ``share`` of its windows: a document that holds enough holds one of
    them.  So windows that a great many documents share are not joined.
    """
    spark = docs.sparkSession
    items = materialise(_windows(benchmark.where("item_id IS NOT NULL"), "item_id", "text", width).withColumnRenamed("id", "item_id"), "bench")
    keys = materialise(items.select("h").distinct(), "bench-keys")
    total = keys.count()
    widths = tuple(sorted(r[0] for r in items.select("n").distinct().collect()))  # at most ``width`` rows
    found = None
    src = docs.where("doc_id IS NOT NULL")
    n_blocks = max(1, -(-total // BLOCK))
    for k in range(n_blocks):  # the benchmark is a stated query set: all documents meet it block by block
        part = keys.select("h") if n_blocks == 1 else keys.where(F.pmod("h", F.lit(n_blocks)) == k).select("h")
        block = np.sort(part.toArrow().column(0).to_numpy())  # bounded by the block size
        if not len(block):
            continue
        hits = _windows(src, "doc_id", "text", width, spark.sparkContext.broadcast(block), widths)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, n_windows long, n_matched long, verbatim boolean")
    hits = found.select(F.col("id").alias("doc_id"), "h", F.col("at").alias("q"), F.col("slots").alias("filled"), F.col("named").alias("read"), "total")
    hits = materialise(hits.distinct(), "bench-hits")
    sizes = items.groupBy("item_id").agg(F.countDistinct("key").alias("n_windows"), F.countDistinct("at").alias("positions"), F.max("n").alias("width"))
    item_keys = items.select("item_id", "h", "key", F.col("at").alias("p"), "slots", "named").distinct()
    # of the places of an item's or document's window one is enough to count it
    holds = hits.select("doc_id", "h").distinct()
    frequent = holds.groupBy("h").agg(F.count("*").alias("df"))
    ranked = item_keys.join(frequent, "h", "left").groupBy("item_id", "key").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("df", "key"))).join(sizes, "item_id")
    probes = ranked.where(F.col("r") <= F.col("n_windows") - F.ceil(F.lit(share) * F.col("n_windows")) + 1).select("item_id", "key")
    probes = materialise(probes.join(item_keys.select("item_id", "key", "h").distinct(), ["item_id", "key"]).select("item_id", "h").distinct(), "bench-probes")
    candidates = materialise(holds.join(probes, "h").select("doc_id", "item_id").distinct(), "bench-candidates")
    pairs = candidates.join(item_keys, "item_id").join(hits, ["doc_id", "h"])
    match = F.struct("key", "p", "q", F.greatest("named", "read").alias("named"), "slots", "filled")
    matches = pairs.groupBy("doc_id", "item_id").agg(F.collect_set(match).alias("matches"), F.countDistinct("key").alias("n_matched"), F.max("total").alias("total")).join(sizes, "item_id")
    matches = matches.where(F.col("n_matched") >= F.lit(share) * F.col("n_windows"))  # a list is bounded by one document's windows
    judge = F.udf(lambda ms, least, positions: _judge([tuple(m) for m in ms], least, positions), "int")
    judged = matches.withColumn("verdict", judge("matches", F.lit(share) * F.col("n_windows"), "positions"))
    judged = judged.where((F.col("verdict") == 2) | ((F.col("verdict") == 1) & (F.col("width") >= width)))
    judged = judged.where((F.col("width") >= min(LEAST, width)) | (F.col("total") == F.col("width")))
    return judged.select("doc_id", "item_id", "n_windows", "n_matched", (F.col("verdict") == 2).alias("verbatim"))


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; rows with a null id stay."""
    mark = written()
    bad = materialise(contaminated(docs, benchmark).select("doc_id").distinct(), "bench-bad")
    discard_since(docs.sparkSession, mark, bad)
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
