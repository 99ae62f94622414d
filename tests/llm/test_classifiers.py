import random
import zlib

import pytest
from samples import prose

from gleaner.llm import quality_classifier, toxicity

BAD = "idiot trash scum".split()


@pytest.fixture(scope="module")
def corpus(spark, make_docs):
    r, rows, labels = random.Random(5), [], []
    for i in range(500):
        w = prose(i, r.randint(30, 120)).split()
        toxic, junk = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not junk), int(toxic), "x"))
    extra = [(900, None), (901, ""), (902, "\n"), (None, "no id"), (903, "😀é " * 50)]
    return make_docs(rows + extra), spark.createDataFrame(labels + [(1, None, None, "x"), (None, 1, 1, "x"), (5, *labels[5][1:])], "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize(("module", "name", "folds", "fold"), [(toxicity, "toxic", 5, 0), (quality_classifier, "quality", 4, 2)])
def test_held_out_accuracy_and_odd_rows(corpus, module, name, folds, fold):
    docs, labels = corpus
    found = module.judged(docs, labels).collect()
    assert len(found) == docs.count()
    want = {r["doc_id"]: r[name] for r in labels.where(f"{name} is not null").collect()}
    right = total = 0
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        if r["held_out"] and r["doc_id"] in want:
            total += 1
            right += r["predicted"] == want[r["doc_id"]]
    assert total > 50 and right / total > 0.9


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_no_labels_and_empty_tables(corpus, module):
    docs, labels = corpus
    assert {r["score"] for r in module.judged(docs.limit(5), labels.where("false")).collect()} == {0.5}
    assert module.judged(docs.where("false"), labels).count() == 0


def test_weights_are_sparse(corpus):
    weights, _ = toxicity.trained(*corpus)
    assert 0 < (weights != 0).sum() < 2000
