"""Small folders of tables for the corpus operators."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TYPES = {
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())],
    "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())],
    "benchmark": [("item_id", pa.int64()), ("text", pa.string())],
    "labels": [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
}
#: Names that the operators use themselves, as further columns of every table.
CLASHING = ["_id", "fp", "component_id", "cell", "k1", "block", "score", "n", "template", "_i", "_left", "at", "rows", "host"]


@pytest.fixture
def tables(tmp_path):
    """Writes rows (tuples in the order of the columns, short ones filled with nulls) as tables of a folder."""

    def write(clash: bool = False, **rows) -> str:
        for name, kinds in TYPES.items():
            have = rows.get(name, [])
            columns = {c: pa.array([r[i] if i < len(r) else None for r in have], t) for i, (c, t) in enumerate(kinds)}
            if clash:
                columns |= {c: pa.array([7] * len(have), pa.int32()) for c in CLASHING if c not in columns}
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def documents(sf_dir):
    """The small documents as (doc_id, text, lang, source, n_chars)."""
    table = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    return list(zip(*(table[c] for c, _ in TYPES["documents"]), strict=True))
