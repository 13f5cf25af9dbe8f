"""The stages of the corpus pipeline one by one, and the registration of all queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from kindred.llm.session import prepare
from kindred.session import folders_made

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    base = " ".join(WORDS)
    rows = [(1, base), (2, base + " more"), (3, "different text altogether, kept as it is"), (4, None), (5, "123 !!"), (6, ""),
            (7, "the password = hunter2222 stays masked; token: abcdefgh end"), (7, "the password = hunter2222 stays masked; token: abcdefgh end"),
            (None, "no id here")]
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, "s", len(t or "")) for i, t in rows], COLUMNS)


def texts(df):
    return sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())


def test_stages_return_the_columns_of_documents(spark, docs):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_language_rejects_texts_without_letters(spark, docs):
    kept = pipeline.language(spark, docs, "")
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 7, 7]
    assert {r["lang"] for r in kept.collect()} == {"en"}


def test_one_document_of_each_group_stays(spark, docs):
    kept = [i for i, _ in texts(pipeline.near_duplicates(spark, docs, ""))]
    assert kept == [0, 1, 3, 4, 5, 6, 7]


def test_rows_of_one_id_are_judged_by_their_text(spark):
    base, other, third = (" ".join(f"{k}{w}" for w in WORDS) for k in "xyz")
    rows = [(1, base), (2, "clean text under the id of a copy"), (2, base + " more"), (None, base), (None, "no id, four times, a copy of itself"),
            (None, "no id, four times, a copy of itself"), (None, "no id, four times, a copy of itself"), (None, "no id, four times, a copy of itself"),
            (None, None), (None, ""), (0, other), (0, third), (8, other + " more"), (9, third + " more"), (None, third + " x"), (3, "a b c"), (3, "a b c"),
            (4, "A b c"), (-5, other + " last")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)
    kept = pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
        [(1, base), rows[1], rows[4], (None, None), (None, ""), (0, third), (3, "a b c"), (-5, other + " last")], key=str)


def test_one_of_many_exact_copies_stays(spark):
    base = " ".join(WORDS)
    rows = [(5, base)] * 40 + [(None, base + " tail")] * 3 + [(None, "short text")] * 30 + [(9, "other words"), (9, None), (9, None), (None, "")]
    frame = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS).repartition(5)
    kept = pipeline.near_duplicates(spark, frame, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
        [(5, base), (None, "short text"), (9, "other words"), (9, None), (9, None), (None, "")], key=str)


def test_extra_columns_of_any_name_come_back(spark):
    names = ["spans", "blob", "key", "doc", "new", "named", "likely", "_row", "component_id", "stays", "_place", "text2"]
    rows = [(1, " ".join(WORDS), "en", "s", 9, *names), (2, " ".join(WORDS) + " x", "en", "s", 9, *names),
            (3, "a token: abcdefgh b", "en", "s", 19, *names), (4, "plain words", "en", "s", 11, *names)]
    frame = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} string" for n in names))
    kept = pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    masked = pipeline.secrets(spark, frame, "")
    changed = (3, "a [SECRET] b", "en", "s", 12, *names)
    assert masked.columns == frame.columns and sorted(map(tuple, masked.collect())) == [*rows[:2], changed, rows[3]]
    without = pipeline.secrets(spark, frame.drop("n_chars"), "")
    assert without.columns == frame.drop("n_chars").columns and without.where("doc_id = 3").first()["text"] == "a [SECRET] b"


def test_a_stage_removes_the_folders_of_those_before(spark, docs):
    before = set(folders_made())
    pipeline.near_duplicates(spark, docs, "").collect()
    left = [f for f in folders_made() if f not in before]
    again = pipeline.near_duplicates(spark, docs, "")
    assert left and set(left) <= set(folders_made()) and again.count() == 7
    kept = [f for f in folders_made() if f not in before]
    pipeline.secrets(spark, docs, "").collect()
    assert not set(kept) & set(folders_made())


def test_secrets_are_masked_and_the_rest_stays(spark, docs):
    out = {r["doc_id"]: r for r in pipeline.secrets(spark, docs, "").collect()}
    assert out[7]["text"] == "the [SECRET] stays masked; [SECRET] end" and out[7]["n_chars"] == len(out[7]["text"])
    before = {r["doc_id"]: r for r in docs.collect()}
    assert all(out[i] == before[i] for i in (1, 2, 3, 4, 5, 6, None))


def test_private_keys_are_masked_whole(spark):
    def key(kind, body, end=None):
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind if end is None else end}PRIVATE KEY-----"
    body = "MIIEpAIBAAKCAQEA7bq\r\n" * 20
    cases = [(f"a {key('RSA ', body)} b", "a [SECRET] b"), (f"{key('', body)}\n{key('EC ', body)}é", "[SECRET]\n[SECRET]é"),
             (f"x -----BEGIN PRIVATE KEY-----\n{body}", "x [SECRET]"), (f"x {key('RSA ', body, 'EC ')} y", "x [SECRET]"),
             (f"x {key('RSA ', key('EC ', body))} y", "x [SECRET] y"), (f"secret = {key('RSA ', body)} z", "[SECRET] z"),
             (f"😀 {key('', body * 20_000)} w", "😀 [SECRET] w"), ("-----END PRIVATE KEY----- no key", "-----END PRIVATE KEY----- no key")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(cases)], COLUMNS)
    got = {r["doc_id"]: r for r in pipeline.secrets(spark, frame, "").collect()}
    for i, (_, masked) in enumerate(cases):
        assert (got[i]["text"], got[i]["n_chars"]) == (masked, len(masked))


def test_run_packs_what_the_stages_keep(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] or 0 for r in rows}) == [0, 1, 3, 7]


def test_every_query_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
