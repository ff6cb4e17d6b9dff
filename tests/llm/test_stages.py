"""Pipeline stages over odd rows and over columns named like those of the operators."""

import collections

import pytest

import corpus_pipeline
from kilnworks.llm import line_dedup

SF = "/root/testdata/sf0.001"
NAMES = (
    "_key _lines _places _kept _doc n_lines n_removed _row _chunk _fp _fp_kept _id_kept _text _toxicity"
    " _text_to_score _at _id place line a b word code extra_1 toxic bucket"
).split()
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(900_001, None), (900_002, ""), (900_003, " \n\t"), (None, "without an id, one"), (None, "without an id, two")]
    rows += [(2**60 + 1, long), (2**60 + 3, "a b c d e\n" + long[:3000]), (900_004, "twice the same row"), (900_004, "twice the same row")]
    odd = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], docs.schema)
    return docs.unionByName(odd).repartition(4).cache()


def clashing(docs):
    return docs.withColumns({name: docs["doc_id"].cast("string") for name in NAMES})


def rows_of(docs, *columns):
    return collections.Counter(map(tuple, docs.select(*columns).collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != "packing"])
def test_a_stage_keeps_columns_of_any_name(spark, plain, name):
    columns = plain.columns
    wide = STAGES[name](spark, clashing(plain), SF)
    assert wide.columns == columns + NAMES
    assert rows_of(wide, *columns) == rows_of(STAGES[name](spark, plain, SF), *columns)
    for row in wide.select("doc_id", *NAMES).collect():
        assert {row[n] for n in NAMES} == {None if row.doc_id is None else str(row.doc_id)}
    empty = STAGES[name](spark, clashing(plain).limit(0), SF)
    assert (empty.count(), empty.columns) == (0, columns + NAMES)


def test_whole_pipeline_takes_odd_rows(spark, plain):
    packed = []
    for docs in (plain, clashing(plain), plain.limit(0)):
        for stage in STAGES.values():
            docs = stage(spark, docs, SF)
        packed.append(rows_of(docs, "doc_id", "start", "length", "ids_crc32", "doc_tokens"))
    assert sum(packed[0].values()) > 100 and not packed[2]
    whole = lambda rows: collections.Counter(doc for (doc, start, *_), n in rows.items() if not start for _ in range(n))
    assert whole(packed[0]) == whole(packed[1])


def test_line_counts_replace_columns_of_their_names(spark, plain):
    out = line_dedup.dedup_lines(clashing(plain))
    assert sorted(out.columns) == sorted(plain.columns + NAMES)
    assert dict(out.dtypes)["n_lines"] == "bigint"
