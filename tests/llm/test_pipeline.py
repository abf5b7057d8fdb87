"""Stages of the pipeline hold what they say, each on its own input, and all of them what plain Python gives."""

import math

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pharmalith.llm import decontaminate, neardups, simhash, toxicity
from pharmalith.llm.bytewords import ALNUM, text_buffer, words_of

from .conftest import SF
from .test_decontaminate import brute as brute_windows, words
from .test_mixing import water
from .test_neardups import brute as brute_groups
from .test_tokenbin import PATH, brute as brute_tokens


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        out[name] = rows
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_columns_and_sizes(stages):
    names = list(stages)
    for name in names[1:-1]:
        assert list(stages[name][0].asDict()) == list(stages["documents"][0].asDict())
    sizes = [len(stages[n]) for n in names]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5]


def test_each_filter_keeps_rows_as_they_were(stages):
    names = list(stages)
    for before, after in zip(names[:3], names[1:4]):
        assert set(map(tuple, stages[after])) <= set(map(tuple, stages[before]))


def test_one_of_each_group_stays(spark, stages):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    groups = neardups.near_duplicates(spark.createDataFrame(stages["toxicity"], schema)).collect()
    assert sorted(r.doc_id for r in stages["simhash_dedup"]) == sorted({r.component_id for r in groups})


def test_what_goes_is_contaminated(spark, stages):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = decontaminate.op6(spark, spark.createDataFrame(stages["simhash_dedup"], schema), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert sorted(r.doc_id for r in stages["decontaminate"]) == sorted(r.doc_id for r in found if not r.contaminated)


def test_copies(stages):
    kept = {r.doc_id for r in stages["decontaminate"]}
    ids = [r.doc_id for r in stages["mix_sources"]]
    assert set(ids) <= kept and max(ids.count(k) for k in set(ids)) == 2
    assert sorted(r.doc_id for r in stages["token_binary"]) == sorted(ids)


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["token_binary"]))


def severities(model, texts):
    """Expected grades, word by word: a feature is a word or its first bytes, and each counts by its logarithm."""
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    hashed = {}
    for text in texts:
        counts = {}
        for word in words(text):
            if word not in hashed:
                hashed[word] = [h for h in toxicity._features(words_of(*text_buffer(pa.array([word])), ALNUM))[0].tolist() if h in weight]
            for h in hashed[word]:
                counts[h] = counts.get(h, 0) + 1
        score = sum(weight[h] * math.log2(1 + n) for h, n in counts.items())
        yield sum(1 - 1 / (1 + math.exp(score - t)) for t in model.thresholds)


def test_stages_are_those_of_brute_force(spark, table, stages):
    """Every decision again in plain Python; of the mix, which is random, its sums and limits."""
    model = toxicity.fit(table("documents"), table("labels"))
    docs = stages["documents"]
    kept = [r for r, x in zip(docs, severities(model, [r.text for r in docs])) if x < toxicity.REJECT_FROM]
    assert sorted(map(tuple, stages["toxicity"])) == sorted(map(tuple, kept))

    least = brute_groups([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if least[r.doc_id] == r.doc_id]
    assert sorted(map(tuple, stages["simhash_dedup"])) == sorted(map(tuple, kept))

    found = brute_windows([(r.doc_id, r.text) for r in kept], [(r.item_id, r.text) for r in table("benchmark").collect()])
    kept = [r for r in kept if not found[r.doc_id][4]]
    assert sorted(map(tuple, stages["decontaminate"])) == sorted(map(tuple, kept))

    size = {r.doc_id: len((r.text or "").split()) for r in kept}
    total, taken, largest, ids = {}, {}, {}, [r.doc_id for r in stages["mix_sources"]]
    for r in kept:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id] * ids.count(r.doc_id)
        largest[r.source] = max(largest.get(r.source, 0), size[r.doc_id])
    target = water(total)
    for r in kept:
        assert math.floor(target[r.source] / total[r.source]) <= ids.count(r.doc_id) <= math.ceil(target[r.source] / total[r.source] - 1e-9)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)

    rows = [(r.doc_id, r.text) for r in stages["mix_sources"]]
    assert sorted(map(tuple, stages["token_binary"])) == brute_tokens(Tokenizer.from_file(PATH), rows)


@pytest.mark.parametrize("keep_one", [simhash.keep_one, neardups.keep_one])
def test_repeated_ids_leave_one_row(spark, keep_one):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "w"), (2, "a b c d e", "y"), (None, "a b c d e", "z"), (5, "p q r s t u", "k"), (5, "p q r s t u", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = keep_one(docs).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 5]
    assert sorted(map(str, kept)) == sorted(map(str, keep_one(docs.repartition(4)).collect()))
    assert keep_one(docs.limit(0)).collect() == []
