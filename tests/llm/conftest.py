import pyarrow as pa
import pyarrow.parquet as pq
import pytest

_DEFAULTS = {
    "canonical_item": [("source", pa.string()), ("source_id", pa.string()), ("title", pa.string()), ("tags", pa.list_(pa.string()))],
    "comment_revision": [("comment_revision_id", pa.string()), ("tags_json", pa.string())],
    "resource_revision": [("resource_revision_id", pa.string()), ("resource_id", pa.string()), ("title", pa.string()), ("content_markdown", pa.string())],
    "page_fetch": [("page_fetch_id", pa.string()), ("url", pa.string()), ("text", pa.string()), ("error", pa.string()), ("content_encoding", pa.string())],
    "payload": [("payload_id", pa.string()), ("content", pa.binary()), ("charset", pa.string())],
    "fetch_capture": [("fetch_capture_id", pa.string()), ("resource_revision_id", pa.string()), ("final_url", pa.string()), ("warning", pa.string())],
    "documents": [("doc_id", pa.int64()), ("text", pa.string())],
    "common_words": [("lang", pa.string()), ("word", pa.string())],
    "pack_capacity": [("container", pa.string()), ("capacity_tokens", pa.int32())],
}


@pytest.fixture
def archive(tmp_path):
    """A folder with all tables; those not given are empty, and all have extra columns with clashing names."""

    def make(**tables) -> str:
        for name, fields in _DEFAULTS.items():
            rows = tables.get(name, [])
            cols = {f: pa.array([r.get(f) for r in rows], t) for f, t in fields}
            for extra in ("value", "node", "hash", "rank", "class", "kind", "n", "field"):
                cols.setdefault(extra, pa.array(["clash"] * len(rows), pa.string()))
            pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return make
