"""Repeated byte strings, by hashed names of growing prefixes.

Strings of WINDOW bytes that start more than once are found level by level: Spark groups (name, stretch) pairs of positions at 100 bytes,
the positions left at 200, then at lengths that halve the rest, until they are unique or known as repeated to the full length.
This takes the place of prefix doubling on a suffix array: a name is a 64-bit hash instead of a place in the sorted order, as only equality
counts, and only sampled positions (anchors, see repeats.py) have rows, since rank pairs of all positions would take over ten times the
input on disk. No (rank, rank) rows are sorted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import binary_rows, map_batches, read
from loomspan.llm.registry import query
from loomspan.llm.repeats import Units, repeated_windows, run_arrays, unpacked, with_runs
from loomspan.llm.windows import covered
from loomspan.llm.work import Work

WINDOW = 400
LENGTHS = (100, 200, 300, 350, 400)
BYTES = Units(words=False)


def remove_byte_repeats(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left; null if digest_only) of every row.

    Null counts as empty and has the hash of the empty string; texts shorter than a window lose nothing; equal rows are
    different places. Matches do not cross documents; they may cut a character, so what is kept is binary.
    """
    runs = repeated_windows(docs, BYTES, window, lengths, Work(docs.sparkSession, "byte-repeats"))

    def step(batch):
        columns = [[] for _ in range(5)]
        for blob, found in zip(binary_rows(batch, "packed"), batch.column(2).to_pylist(), strict=True):
            text = unpacked(blob) or b""
            kept, n_removed, n_spans = text, 0, 0
            if found:
                removed = covered(*run_arrays(found), window, len(text))
                kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
                n_removed, n_spans = int(removed.sum()), int((np.diff(removed.astype(np.int8), prepend=0) == 1).sum())
            for column, value in zip(columns, (len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), None if digest_only else kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                                          names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(with_runs(docs, runs), step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
 p AS (SELECT r, x, unnest(generate_series(1, len(x) // 2 - {WINDOW - 1})) AS s FROM d),
 k AS (SELECT r, s, md5(substr(x, 2 * s - 1, {2 * WINDOW})) AS h FROM p),
 m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
 g AS (SELECT r, s, s - lag(s, 1, -{WINDOW} - 1) OVER (PARTITION BY r ORDER BY s) > {WINDOW} AS fresh FROM k JOIN m USING (h)),
 v AS (SELECT r, s, sum(fresh::INT) OVER (PARTITION BY r ORDER BY s) AS span FROM g),
 c AS (SELECT r, min(s) AS a, max(s) + {WINDOW - 1} AS b FROM v GROUP BY r, span),
 n AS (SELECT r, count(*) AS spans, sum(b - a + 1) AS removed FROM c GROUP BY r),
 e AS (SELECT r, a, b FROM c UNION ALL SELECT r, 0, 0 FROM d UNION ALL SELECT r, len(x) // 2 + 1, len(x) // 2 + 1 FROM d),
 q AS (SELECT r, b + 1 AS a, lead(a) OVER (PARTITION BY r ORDER BY a, b) - 1 AS b FROM e),
 l AS (SELECT q.r, string_agg(substr(x, 2 * a - 1, 2 * (b - a + 1)), '' ORDER BY a) AS kept FROM q JOIN d ON d.r = q.r WHERE b >= a GROUP BY q.r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
 sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN l USING (r)"""


@query("op9_byte_repeats", SQL)
def op9_byte_repeats(spark, sf_dir):
    return remove_byte_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), digest_only=True).drop("kept")
