"""Every registered query of this subpackage on the smallest tables: columns, types and folds as stated, and its SQL where it has some."""

import hashlib
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

from quillon.llm.queries import ORACLE_SQL, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id bigint, start bigint, length bigint, secret boolean",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_one_query_for_each_operator():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, texts, name):
    frame = QUERIES[name](spark, SF)
    kinds = dict(frame.dtypes)
    assert {k: kinds.get(k) for k in (c.split()[0] for c in COLUMNS[name].split(", "))} == dict(c.split() for c in COLUMNS[name].split(", "))
    got = frame.collect()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(ORACLE_SQL[name])
        order = [want.columns.index(c) for c in frame.columns]
        assert sorted(frame.columns) == sorted(want.columns)
        assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
    if "held_out" in kinds:
        parts, fold = (5, 0) if name.startswith("op6") else (4, 2)
        assert len(got) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == fold) and 0 <= r.score <= 1 for r in got)
    if name.startswith("op6"):
        assert all(r.predicted == (r.score >= 0.3) for r in got)
    if name.startswith("op2"):
        library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
        assert all(r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in got)
    if name.startswith("op5"):
        own: dict[int, list] = {}
        for r in got:
            own.setdefault(r.doc_id, []).append(r)
        library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
        for k, t in texts.items():
            ids = [*library.encode(t, add_special_tokens=False).ids, 2]
            at = 0
            for r in sorted(own[k], key=lambda r: r.start):
                piece = b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length])
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece))
                at += r.length
            assert at == len(ids)
    if name.startswith("op11"):
        order = sorted(texts, reverse=True)
        following = dict(zip(order, order[1:] + order[:1], strict=True))
        for r in got:
            t, n = texts[r.doc_id], len(texts[r.doc_id])
            edited = t[: n - n // 3] + texts[following[r.doc_id]][: n // 3]
            assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_next <= 1 and (r.near_edited > 0.4 or n < 8)
