"""Problem 6: texts into containers of a fixed number of tokens, by first-fit decreasing.

Sizes are tokens of a public tokenizer, whose file is a parameter. A text that alone exceeds the capacity is split at
word boundaries of the tokenizer into parts that do not. The parts are dealt to groups at random (by hash), each of about
GROUP parts, and every group is packed by itself: parts in decreasing order go to the first container with room, which a
tournament tree over the room left in the containers finds in logarithmic time. Groups hold sizes only, no texts, and do
not depend on source or document, so no group is hot.

Null and empty texts take no room and are in no container. A capacity that is null or not positive has no packing.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship, spread
from ._arrow import map_columns

#: Parts of a group, on average.
GROUP = 20_000

_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(path: str | None = None, pattern: str | None = None):
    """The tokenizer of a file of ranks; by default the public byte-level one for many languages."""
    import tiktoken

    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _ENCODINGS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def spans(text: str, tokens, words) -> list[tuple[int, int, int]]:
    """(start, end, size) of the words of a text as the tokenizer cuts it; no token reaches over their edges."""
    return [(m.start(), m.end(), tokens(m[0])) for m in words(text)]


def parts(text: str, capacity: int, tokens, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, size) of the parts of a text, none larger than the capacity; own are its spans."""
    cuts, start, room = [], 0, capacity
    for begin, end, size in own:
        need = size
        while need > room:
            if start < begin:
                cuts.append(begin)
                start, room = begin, capacity
                continue
            # one word beyond the capacity: as many characters as fit
            low, high = start + 1, end
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if tokens(text[start:middle]) <= capacity else (low, middle - 1)
            cuts.append(low)
            begin = start = low
            room = capacity
            need = tokens(text[start:end])
        room -= need
    out, begin = [], 0
    for end in [*cuts, len(text)]:
        if begin < end:
            out += _sized(text, begin, end, capacity, tokens)
        begin = end
    return out


def _sized(text: str, begin: int, end: int, capacity: int, tokens) -> list[tuple[int, int, int]]:
    """A part with its size as the tokenizer gives it; halved where its edges are read in another way and it grows."""
    size = tokens(text[begin:end])
    if size <= capacity or end - begin < 2:
        return [(begin, end, size)]
    middle = (begin + end) // 2
    return _sized(text, begin, middle, capacity, tokens) + _sized(text, middle, end, capacity, tokens)


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size; sizes above the capacity get one for themselves."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # a node holds the most room of the containers below it
    out = [0] * len(sizes)
    beyond = leaves
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if size > capacity:
            out[i] = beyond
            beyond += 1
            continue
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out[i] = node - leaves
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return out


def pack(documents: DataFrame, budgets: DataFrame, path: str | None = None, pattern: str | None = None, group: int = GROUP, seed: int = 7) -> DataFrame:
    """(budget_id, container, doc_id, part_no, start_pos, end_pos, n_tokens): the parts of documents(doc_id, text) in
    containers of budgets(budget_id, capacity_tokens); containers are numbered group-wise, as 'group-number'."""
    spark = documents.sparkSession
    ship(spark)
    capacities = {r.budget_id: r.capacity_tokens for r in budgets.select("budget_id", "capacity_tokens").distinct().toLocalIterator() if r.capacity_tokens and r.capacity_tokens > 0}

    def measure(columns: dict[str, list]) -> dict[str, list]:
        import regex

        coder = encoding(path, pattern)
        words = regex.compile(coder._pat_str).finditer

        def tokens(text: str) -> int:
            return len(coder.encode_ordinary(text))

        @lru_cache(maxsize=100_000)
        def word_tokens(word: str) -> int:
            return len(coder.encode_ordinary(word))

        out: dict[str, list] = {k: [] for k in ("budget_id", "doc_id", "part_no", "start_pos", "end_pos", "n_tokens")}
        for key, text in zip(columns["doc_id"], columns["text"], strict=True):
            size = tokens(text)
            own = spans(text, word_tokens, words) if any(size > c for c in capacities.values()) else []
            for budget, capacity in capacities.items():
                cuts = [(0, len(text), size)] if size <= capacity else parts(text, capacity, tokens, own)
                for k, (a, b, n) in enumerate(cuts):
                    for name, value in zip(out, (budget, key, k, a, b, n), strict=True):
                        out[name].append(value)
        return out

    schema = "budget_id int, doc_id bigint, part_no int, start_pos int, end_pos int, n_tokens int"
    rows = spread(documents.select("doc_id", "text").where("text <> ''"))
    sized = cut(map_columns(rows, measure, schema).dropDuplicates(["budget_id", "doc_id", "part_no"]))
    counts = {r.budget_id: r.n for r in sized.groupBy("budget_id").agg(F.count("*").alias("n")).toLocalIterator()}
    groups = {b: max(1, math.ceil(n / group)) for b, n in counts.items()}
    if not groups:
        return sized.select("budget_id", F.lit("").alias("container"), "doc_id", "part_no", "start_pos", "end_pos", "n_tokens").limit(0)
    number = F.element_at(F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]), F.col("budget_id"))
    dealt = sized.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part_no"), number).cast("int"))

    def fill(key, rows):
        import pyarrow as pa

        budget, number = key[0].as_py(), key[1].as_py()
        rows = rows.sort_by([("doc_id", "ascending"), ("part_no", "ascending")])  # the same packing on every attempt
        places = first_fit_decreasing(rows["n_tokens"].to_pylist(), capacities[budget])
        return rows.select(["budget_id"]).append_column("container", pa.array([f"{number}-{p}" for p in places], pa.string())).append_column("doc_id", rows["doc_id"]).append_column("part_no", rows["part_no"]).append_column("start_pos", rows["start_pos"]).append_column("end_pos", rows["end_pos"]).append_column("n_tokens", rows["n_tokens"])

    return dealt.groupBy("budget_id", "grp").applyInArrow(fill, "budget_id int, container string, doc_id bigint, part_no int, start_pos int, end_pos int, n_tokens int")


def fill_rates(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, parts, tokens, fill): how full the containers of each budget are."""
    sums = packed.groupBy("budget_id").agg(F.count_distinct("container").alias("containers"), F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))
    capacity = budgets.groupBy("budget_id").agg(F.max("capacity_tokens").alias("capacity"))
    return sums.join(capacity, "budget_id").select("budget_id", "containers", "parts", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
