"""The stages on a small table against plain versions, each on what its predecessor kept."""
import __spark_entry__
import brute
import corpus_pipeline
from chronoline.llm import packing
from test_decontamination import brute as held
from test_packing import check
from test_simhash import brute_fingerprint, brute_similar

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    """Least id of each group: 3 bits of three-word shingles, or similar in five-word shingles."""
    fps, texts = [brute_fingerprint(t) for _, t in rows], [t for _, t in rows]
    links = brute_similar(texts) | {(i, j) for i in range(len(rows)) for j in range(i, len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 3}
    group = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return {min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before.collect(), docs.collect()))
        assert k == 4 or docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    before, after = kept[0]
    assert ids(after) == sorted(r.doc_id for r, good in zip(before, brute.kept([r.text for r in before]), strict=True) if good)
    before, after = kept[1]
    assert ids(after) == sorted(brute_groups([(r.doc_id, r.text) for r in before]))
    before, after = kept[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {int(d) for d, *_ in held([(r.doc_id, r.text) for r in before], items)}
    assert leaks and ids(after) == sorted({r.doc_id for r in before} - leaks)
    before, after = kept[3]
    assert ids(after) == ids(before) and all(r.n_chars == len(r.text) for r in after)
    changed = {r.doc_id for r in before} - {a.doc_id for a in after if a in set(before)}
    assert len(changed) < len(before)
    before, after = kept[4]
    check(after, {r.doc_id: r.text for r in before}, packing._words(None), 2048)


def test_cases_through_all_stages(spark, tmp_path):
    """Null texts and ids, repeated rows, clashing columns; then an empty table."""
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()
            if r.text and 200 < len(r.text) < 3000 and brute.counts(r.text)["n_words"] > 40][:60]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1, "y") for r in good]
    rows += [rows[0], (None, rows[1][1] + " more words here", *rows[1][2:]), (900001, None, "en", "s", 0, "x", 1, "y"),
             (900002, "", "en", "s", 0, "x", 1, "y"), (None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, __row int, shingles string"
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            assert k == 4 or docs.columns == [c.strip().split()[0] for c in schema.split(",")]
            found = docs.collect()
            assert bool(found) == bool(table)
            if k < 4:
                # The repeated row goes with the near-duplicates.
                assert all(r.text for r in found) and (k == 0 or len({(r.doc_id, r.text) for r in found}) == len(found))


def test_run_and_registration(spark):
    queries = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in queries if k.startswith("op") and k[2].isdigit()}
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    rows = queries["pipeline"](spark, SF)
    assert rows.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)
