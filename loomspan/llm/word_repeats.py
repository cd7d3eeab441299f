"""Substring dedup on words by level-wise doubling.

Windows of WINDOW words that start more than once are found level by level: parts of 9 words first, the windows whose part is
repeated are extended to 18 words, and what survives to the whole 35 (a last step shorter than a doubling), until no
candidate is left undecided. Every word covered by such a window is removed. See repeats.py for the search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import WORD, binary_rows, map_batches, read
from loomspan.llm.registry import query
from loomspan.llm.repeats import Units, repeated_windows, run_arrays, unpacked, with_runs
from loomspan.llm.windows import covered
from loomspan.llm.work import Work

WINDOW = 35
LENGTHS = (9, 18, 35)
WORDS = Units(words=True)


def remove_word_repeats(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS, digest_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one blank; null if digest_only) of every row.

    Null and empty texts have no words and the hash of the empty string; texts shorter than a window lose nothing; equal
    rows are different places, so they repeat each other. Windows are judged on the input.
    """
    runs = repeated_windows(docs, WORDS, window, lengths, Work(docs.sparkSession, "word-repeats"))

    def step(batch):
        columns = [[] for _ in range(4)]
        for blob, found in zip(binary_rows(batch, "packed"), batch.column(2).to_pylist(), strict=True):
            words = WORDS.split(unpacked(blob))
            removed = covered(*run_arrays(found), window, len(words)) if found else np.zeros(len(words), bool)
            kept = b" ".join(words[i] for i in np.flatnonzero(~removed)) if found else b" ".join(words)
            for column, value in zip(columns, (len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest(), None if digest_only else kept), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays[:3], arrays[3].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_batches(with_runs(docs, runs), step, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
 p AS (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS s FROM d),
 k AS (SELECT r, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS h FROM p),
 m AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
 c AS (SELECT DISTINCT r, s + o.o AS i FROM k JOIN m USING (h), range({WINDOW}) o(o)),
 t AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
 l AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (r)"""


@query("op8_word_repeats", SQL)
def op8_word_repeats(spark, sf_dir):
    return remove_word_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), digest_only=True).drop("kept")
