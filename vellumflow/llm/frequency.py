"""Frequencies of every distinct term and n-gram: occurrences, and records they occur in, from suffix arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellumflow.plans.tables import drop_repeats

#: A suffix array is built whenever this many symbols have come together; it bounds a task's memory, not the result.
CHUNK_SYMBOLS = 400_000
#: A term is too common to be useful in more than this share of all records, in hundredths; too rare in one record.
COMMON_PERCENT = 1

START, END, FIRST_WORD = 0, 1, 2


def normal_form(entry: str) -> str:
    """Unicode NFC, lower case, every run of white space as one space, ends trimmed."""
    return " ".join(unicodedata.normalize("NFC", entry).lower().split())


class SuffixArray:
    """Sorted suffixes of entries written START word ... END, one after the other, with their common-prefix lengths.

    A suffix reaches to the end of its entry, so equal suffixes are suffixes with equal remaining words. Built by prefix
    doubling: ``levels[k]`` ranks every position by its next 2**k symbols, from which the common prefix of two neighbours
    is read by descending the levels. Equal suffixes stay in order of position.
    """

    def __init__(self, symbols: np.ndarray, remaining: np.ndarray):
        n = len(symbols)
        self.remaining = remaining  # symbols from a position to its entry's END, both counted
        self.levels = [symbols.astype(np.int64)]
        step, longest = 1, int(remaining.max(initial=0))
        while step < longest:
            rank = self.levels[-1]
            later = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(remaining > step)
            later[inside] = rank[inside + step] + 1
            _, rank = np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)
            self.levels.append(rank.astype(np.int64))
            step *= 2
        self.order = np.argsort(self.levels[-1], kind="stable") if n else np.zeros(0, np.int64)
        self.common = self._common_prefixes()

    def _common_prefixes(self) -> np.ndarray:
        """Length of the prefix each suffix shares with the one before it in order; 0 for the first."""
        common = np.zeros(len(self.order), dtype=np.int64)
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.remaining[a], self.remaining[b])
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            open_ = np.flatnonzero(length < most)
            same = open_[rank[a[open_] + length[open_]] == rank[b[open_] + length[open_]]]
            length[same] = np.minimum(length[same] + (1 << k), most[same])
        common[1:] = length
        return common

    def intervals(self, kept: np.ndarray, length: np.ndarray | int, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(representative position, occurrences, records) of each interval of suffixes that share ``length`` symbols.

        ``kept`` marks the places in order that take part; neighbours belong to one interval while the shortest common
        prefix between them is at least ``length``. The number of records is the number of occurrences less the adjacencies
        of two occurrences in one record, once the interval is in order of record.
        """
        if not kept.any():
            none = np.zeros(0, np.int64)
            return none, none, none
        places = np.flatnonzero(kept)
        lowest = np.minimum.reduceat(self.common[: places[-1] + 1], np.concatenate(([0], places[:-1] + 1)))
        begins = lowest < (length[places] if isinstance(length, np.ndarray) else length)
        begins[0] = True
        run = np.cumsum(begins) - 1
        owner = record[self.order[places]]
        by = np.lexsort((owner, run))
        again = (run[by][1:] == run[by][:-1]) & (owner[by][1:] == owner[by][:-1])
        occurrences = np.bincount(run)
        return self.order[places[begins]], occurrences, occurrences - np.bincount(run[by][1:][again], minlength=len(occurrences))


class _Chunk:
    """Entries of one field, as many as fit together, with the record each stands in."""

    def __init__(self, entry_of: np.ndarray, record_of: np.ndarray, terms: list[str]):
        words: dict[str, int] = {}
        spelt = [[words.setdefault(w, len(words) + FIRST_WORD) for w in t.split(" ")] for t in terms]
        lengths = np.fromiter((len(s) + 2 for s in spelt), np.int64, len(spelt))
        flat = np.fromiter((x for s in spelt for x in (START, *s, END)), np.int64, int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        per = lengths[entry_of]
        total = int(per.sum())
        first = np.concatenate(([0], np.cumsum(per)))[:-1]
        within = np.arange(total) - np.repeat(first, per)
        self.symbols = flat[np.repeat(starts[entry_of], per) + within]
        self.remaining = np.repeat(per, per) - within
        self.record = np.repeat(record_of, per)
        self.entry = np.repeat(entry_of, per)
        self.within, self.terms = within, terms
        self.longest = int(per.max(initial=2)) - 2  # words
        self.suffixes = SuffixArray(self.symbols, self.remaining)

    def whole_terms(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        sa = self.suffixes
        at, occurrences, records = sa.intervals(self.symbols[sa.order] == START, self.remaining[sa.order], self.record)
        return [self.terms[e] for e in self.entry[at]], occurrences, records

    def ngrams(self, n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        sa = self.suffixes
        kept = (self.symbols[sa.order] != START) & (self.remaining[sa.order] > n)
        at, occurrences, records = sa.intervals(kept, n, self.record)
        split = {}
        texts = []
        for e, w in zip(self.entry[at].tolist(), self.within[at].tolist()):
            if e not in split:
                split[e] = self.terms[e].split(" ")
            texts.append(" ".join(split[e][w - 1 : w - 1 + n]))
        return texts, occurrences, records


def _entries(batch: pa.RecordBatch, field: str, first_record: int) -> tuple[pa.Array, np.ndarray]:
    lists = batch.column(batch.schema.get_field_index(field))
    values, owners = pc.list_flatten(lists), pc.list_parent_indices(lists)
    given = pc.is_valid(values)
    return values.filter(given), owners.filter(given).to_numpy(zero_copy_only=False).astype(np.int64) + first_record


def _counted(batches: Iterator[pa.RecordBatch], fields: list[str], orders: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Term (order 0) and n-gram counts of this task's records, a suffix array for each field and chunk."""

    def result(values: list[tuple[pa.Array, np.ndarray]], field: str) -> Iterator[pa.RecordBatch]:
        encoded = pa.chunked_array([v for v, _ in values]).combine_chunks().dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False)
        record = np.concatenate([r for _, r in values])
        ids: dict[str, int] = {}
        to = np.array([ids.setdefault(normal_form(x), len(ids)) for x in encoded.dictionary.to_pylist()], dtype=np.int64)
        entry = to[code] if len(code) else np.zeros(0, np.int64)
        some = entry != ids.get("", -1)
        chunk = _Chunk(entry[some], record[some], list(ids))
        for n in range(1, chunk.longest + 1) if orders is None else orders:
            texts, occurrences, records = chunk.ngrams(n) if n else chunk.whole_terms()
            size = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * size, pa.string()), pa.array([n] * size, pa.int32()), pa.array(texts, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())],
                names=["field_name", "n_words", "term", "occurrences", "n_records"],
            )

    held: dict[str, list] = {f: [] for f in fields}
    records = symbols = 0
    for batch in batches:
        for f in fields:
            values, owners = _entries(batch, f, records)
            held[f].append((values, owners))
            symbols += len(values) * 2 + (pc.sum(pc.binary_length(values)).as_py() or 0) // 6
        records += batch.num_rows
        if symbols >= CHUNK_SYMBOLS:
            for f in fields:
                yield from result(held[f], f)
            held, records, symbols = {f: [] for f in fields}, 0, 0
    if records:
        for f in fields:
            yield from result(held[f], f)


def term_frequencies(records: DataFrame, key: str, fields: list[str], orders: list[int] | None = [0]) -> DataFrame:  # noqa: B006
    """(field_name, n_words, term, occurrences, n_records) of every term of the list columns ``fields``.

    Order 0 stands for whole entries (n_words 0), n for the n-grams inside entries; no ``orders`` are all n there are. Entries are compared in normal form;
    null, empty and blank entries are no terms; null and empty lists count nothing; repeats of a record (same ``key``) count
    once and rows without key not at all. Each task builds suffix arrays over chunks of whole records and sends on one row
    for each different term of a chunk, so a term that stands in a third of all records costs one row a chunk; as no record
    is in two chunks, occurrences and records simply add up.
    """
    once = drop_repeats(records.select(key, *fields).where(F.col(key).isNotNull()), [key]).select(*fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, fields, orders)

    local = once.mapInArrow(count, "field_name string, n_words int, term string, occurrences long, n_records long")
    return local.groupBy("field_name", "n_words", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("n_records").alias("n_records"))


def marked(frequencies: DataFrame, n_records: int) -> DataFrame:
    """``frequencies`` with mark: 'rare' in one record, 'common' in more than COMMON_PERCENT of ``n_records``, else 'useful'.

    A term of which both hold (there are fewer than a hundred records) is 'rare'.
    """
    mark = F.when(F.col("n_records") == 1, "rare").when(F.col("n_records") * 100 > F.lit(COMMON_PERCENT * n_records), "common").otherwise("useful")
    return frequencies.withColumn("mark", mark)


def evidence_terms(evidence: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, n_records, mark) of every distinct person and place term of the evidence."""
    total = evidence.agg(F.count_distinct("evidence_id")).first()[0]
    return marked(term_frequencies(evidence, "evidence_id", ["people", "places"]), total).drop("n_words")


@F.pandas_udf(StringType())
def normal(entry: pd.Series) -> pd.Series:
    return entry.map(lambda x: normal_form(x) if isinstance(x, str) else None)


def checked_terms(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """:func:`evidence_terms` with recorded_mentions: what name_records say of a person term over all runs (null if nothing).

    Repeats of a name record count once; null mentions count 0.
    """
    own = drop_repeats(names.select("name_id", "name_string", F.coalesce("mentions", F.lit(0)).alias("mentions")).where("name_id is not null"), ["name_id"])
    said = own.withColumn("term", normal("name_string")).where("term <> ''").groupBy("term").agg(F.sum("mentions").alias("recorded_mentions")).withColumn("field_name", F.lit("people"))
    return evidence_terms(evidence).join(said, ["field_name", "term"], "left")


def evidence_ngrams(evidence: DataFrame) -> DataFrame:
    """(field_name, n_words, ngram, occurrences, n_records, mark) of every n-gram inside the entries, up to the longest entry's words."""
    total = evidence.agg(F.count_distinct("evidence_id")).first()[0]
    return marked(term_frequencies(evidence, "evidence_id", ["people", "places"], None), total).withColumnRenamed("term", "ngram")
