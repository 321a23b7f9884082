"""The queries against their SQL, and against brute force where SQL can't express them."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from murmuration.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def cells(values, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("None" if r[k] is None else repr(round(r[k], 6)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = Q.QUERIES[name](spark, SF)
    wanted = c.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert cells([tuple(r) for r in found.collect()], found.columns) == cells(wanted.fetchall(), columns)


def test_op1_payload_is_the_text(spark, documents):
    got = {r["doc_id"]: r for r in Q.QUERIES["op1_matroska"](spark, SF).collect()}
    assert len(got) == len(documents)
    for i, text, _, _ in documents:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r["media_bytes"] > r["payload_bytes"] and r["feature"].endswith("error=")


def test_op3_pieces_tile_documents_and_sequences(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4") for i, text, _, _ in documents}
    pieces = Q.QUERIES["op3_packing"](spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
        assert at == len(x)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0


def test_op4_held_out_accuracy(spark, documents):
    lang = {i: x for i, _, x, _ in documents}
    got = Q.QUERIES["op4_language_ppm"](spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9


@pytest.mark.parametrize("name,mod,out,cut", [("op7_toxicity", 3, 1, 0.7), ("op9_quality_rank", 5, 0, 0.3)])
def test_op7_and_op9_rows(spark, documents, name, mod, out, cut):
    got = Q.QUERIES[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_op10_base_spans(spark, documents):
    kinds = [("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    got = {r["doc_id"]: r for r in Q.QUERIES["op10_secret_scan"](spark, SF).collect()}
    for i, text, _, _ in documents:
        spans = []
        for k, (kind, pattern) in enumerate(kinds):
            for m in pattern.finditer(text or ""):
                if len(m[2]) >= 6 if kind == "assign" else m.end() - m.start() >= (20 if kind == "access" else 24):
                    spans.append((m.start(), k, kind, m.end()))
        spans.sort()
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for _, _, k, _ in spans) for kind in ("assign", "access", "hex"))
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_pipeline(spark, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, texts = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        from murmuration.llm.common import materialise

        docs = materialise(stage(spark, docs, SF), "test-stage")
        if k < 4:
            assert docs.columns == names
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, exact, near, mixed = texts
    assert len(toxic) > 0.7 * len(documents)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t) for t in exact.values()]
    assert len(set(bare)) == len(bare) and {re.sub(r"[\x20\x09-\x0D]", "", t) for t in toxic.values()} == set(bare)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in exact.items()}
    ids, group = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert set(near) == {i for i, g in group.items() if i == g}
    assert set(mixed) <= set(near)
    assert sum(r["length"] for r in docs.collect()) > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())) == sorted((r["doc_id"], r["start"], r["length"]) for r in docs.collect())
