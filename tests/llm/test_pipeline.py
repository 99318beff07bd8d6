import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import COLUMNS
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_neardup import brute as classes

# Names that the stages might use for columns of their own.
EXTRA = ["_id", "id", "named", "key", "kept", "contaminated", "component_id", "predicted", "row", "n"]


def test_each_stage_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    item = " ".join(rng.choice(words) for _ in range(15))
    docs, labels = [], []
    for i in range(260):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
        if i % 5 == 0:
            text = text.replace(" ", " gudgex ", 2)
        if i % 11 == 1:
            text += " " + item
        if i % 13 == 2:
            text = docs[-1][1].replace(" ", "  ") + " end"
        if i % 7 == 3:
            text += f" mail user{i}@mail.example.com"
        docs.append((i, text))
        labels.append((i, 1, int("gudgex" in text)))
    docs += [(3, docs[3][1]), (500, None), (501, ""), (None, "some text of its own")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS) \
        .withColumns({c: F.lit(f"own {c}") for c in EXTRA}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    kept, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = kept.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, d).write.parquet(f"{d}/{k}")
        kept = spark.read.parquet(f"{d}/{k}")
        if name != "packing":
            assert kept.columns == columns
            assert all({r[c] for r in kept.select(c).distinct().collect()} == {f"own {c}"} for c in EXTRA)
            out[name] = [(r.doc_id, r.text) for r in kept.collect()]

    clean = [x for x in docs if "gudgex" not in (x[1] or "")]
    assert sorted(out["toxicity"], key=str) == sorted(clean, key=str)
    unique = list(dict.fromkeys(clean))
    names = dict(enumerate(unique))
    want = classes([(k, t) for k, (_, t) in names.items()], 5)
    groups = {}
    for k, (_, component) in want.items():
        groups.setdefault(component, []).append(names[k])
    stays = out["near_duplicates"]
    assert len(stays) == len(groups) and all(sum(x in stays for x in g) == 1 for g in groups.values())
    hit = {(r[0], t) for (i, t) in stays for r in hits([(i, t)], [(1, item)]) if r[5]}
    assert hit and sorted(out["decontamination"], key=str) == sorted((x for x in stays if x not in hit), key=str)
    assert len(out["pii"]) == len(out["decontamination"])
    assert not any("user" in (t or "") and "mail.example.com" in t for _, t in out["pii"])
    untouched = [x for x in out["decontamination"] if "@" not in (x[1] or "")]
    assert all(x in out["pii"] for x in untouched)
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == sorted({i for i, _ in out["pii"]}, key=str)
    assert corpus_pipeline.run(spark, d).count() == kept.count()
