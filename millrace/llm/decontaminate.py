"""Benchmark decontamination.

Windows of the normalised test items form one Aho-Corasick automaton; each document is
normalised, scanned once, and its matches are mapped back to words and to offsets of the
original text. Nothing is shuffled: the documents pass through one map.

The automaton takes WINDOWS_PER_PASS windows, which bounds what is broadcast and what a worker
holds; a larger benchmark takes further passes, each with an automaton of its own. Rows are written
between passes, so that no two automata are held at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WORD_TABLE, spread, stage_table, table, trimmed, words_of, worker_state

WINDOW = 10
WINDOWS_PER_PASS = 40_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def windows_of(text: str | None, size: int = WINDOW) -> list[tuple[bytes, int]]:
    """(window, number of words) of an item; one window if it has fewer words, none without words."""
    words = words_of(text)
    if not words:
        return []
    n = min(size, len(words))
    return [(b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)]


def window_passes(items: DataFrame, size: int = WINDOW, limit: int = WINDOWS_PER_PASS):
    """Dictionaries window -> (words, item ids), each of about limit windows."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for row in items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text").toLocalIterator():
        for window, n in windows_of(row["text"], size):
            found.setdefault(window, (n, set()))[1].add(row["id"])
        if len(found) >= limit:
            yield found
            found = {}
    yield found


def _automaton(shared):
    """This worker's automaton of a broadcast dictionary."""

    def built():
        import ahocorasick

        made = ahocorasick.Automaton()
        for window, (n, ids) in shared.value["windows"].items():
            made.add_word(f" {window.decode('latin-1')} ", (n, ids))
        if len(made):
            made.make_automaton()
        return made

    return worker_state(shared.value["key"], built)


def find(automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, runs of hit words (start, end), items) of a text."""
    words = words_of(text)
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    if words and len(automaton):
        hits = list(automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if hits:
            ends = np.cumsum([len(w) + 1 for w in words])
            last = np.searchsorted(ends, [e for e, _ in hits])
            for k, (_, (n, ids)) in zip(last.tolist(), hits, strict=True):
                runs.append((k - n + 1, k + 1))
                items |= ids
    return len(words), runs, items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, runs: list[tuple[int, int]]) -> str:
    """Runs of words as start:end in code points of the original text, comma-joined."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(WORD_TABLE))]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return ",".join(f"{points[at[a][0]]}:{points[at[b - 1][1]]}" for a, b in runs)


#: Words, runs of hit words (start, end, start, ...) and items that earlier passes have found.
FOUND = [("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("found", pa.list_(pa.string()))]
SCANNED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *FOUND])
SCANNED_SQL = "doc_id long, text string, n_words long, runs array<long>, found array<string>"


def _scan(shared, first: bool):
    def run(batches):
        automaton = _automaton(shared)
        for batch in batches:
            found = [find(automaton, t.as_py()) for t in batch.column(1)]
            runs, items = [[x for r in f[1] for x in r] for f in found], [f[2] for f in found]
            if not first:
                runs = [a + b for a, b in zip(batch.column(3).to_pylist(), runs, strict=True)]
                items = [b.union(a) for a, b in zip(batch.column(4).to_pylist(), items, strict=True)]
            made = zip(([f[0] for f in found], runs, [sorted(i) for i in items]), FOUND, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, (_, k) in made)], schema=SCANNED)

    return run


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.string())]
)
RESULT_SQL = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans string"


def _digest(batches):
    for batch in batches:
        out = []
        for text, runs, items in zip(batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            got = merged([*zip(runs[::2], runs[1::2], strict=True)])
            hit = sum(b - a for a, b in got)
            out.append((hit, len(items), items, hashlib.sha256(",".join(items).encode("utf-8", "surrogatepass")).hexdigest(), hit > 0, original_spans(text.as_py(), got) if got else ""))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[k] for r in out], f.type) for k, f in enumerate([*RESULT][2:]))], schema=RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = WINDOWS_PER_PASS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans) for each row of docs.

    docs needs doc_id and text, items item_id and text; other columns are ignored. items are the ids as sorted strings, spans
    the merged runs of hit words as start:end in code points. A null or empty text has no words; a very long one is scanned
    whole, and a task holds one batch of texts; items without id or without words match nothing; repeated rows
    of docs give repeated results, repeated items count once; an empty table gives no rows, and without items no row is contaminated.
    """
    sc, out, first = docs.sparkSession.sparkContext, docs.select(F.col("doc_id").cast("long"), "text"), True
    for windows in window_passes(items, size, limit):
        if first or windows:
            out = out if first else stage_table(out, "scanned")
            shared = sc.broadcast({"key": uuid.uuid4().hex, "windows": windows})
            out = out.mapInArrow(trimmed(_scan(shared, first)), SCANNED_SQL)
            first = False
    return out.mapInArrow(_digest, RESULT_SQL)


def _clean(shared):
    def run(batches):
        automaton = _automaton(shared)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not find(automaton, t.as_py())[1] for t in texts], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = WINDOWS_PER_PASS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of an item."""
    for k, windows in enumerate(window_passes(items, size, limit)):
        if not k or windows:
            docs = stage_table(docs, "clean") if k else docs
            shared = docs.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "windows": windows})
            docs = docs.mapInArrow(trimmed(_clean(shared)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate() of all documents against the whole benchmark, without texts' spans."""
    docs, items = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    return decontaminate(docs, items).drop("items", "spans")


ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), ip AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM iw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS t FROM ip
), dp AS (
  SELECT rid, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), dt AS (
  SELECT dp.rid, dp.n, dp.p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS t FROM dp JOIN dw USING (rid)
), hit AS (
  SELECT rid, dt.n, p, item FROM dt JOIN win ON dt.t = win.t AND dt.n = win.n
), pos AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
