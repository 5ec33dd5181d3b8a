"""The pipeline against a brute-force version of its stages."""

import itertools
import os
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from clausegrain.llm import pii, quality, simhash
from tests.llm.test_llm import contaminated, finger, grouped, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with junk, copies, benchmark passages and personal data among clean prose."""
    d = tmp_path_factory.mktemp("sf")
    item = prose(40)
    base = prose(200)
    rows = [(k, prose(80 + k), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s0"), (102, base.replace(" ", "\t"), "en", "s1"), (103, f"{item} {prose(30)}", "en", "s1"), (104, "### $$$ " * 40, "en", "s2"), (105, None, "en", "s2"), (106, "again and again and more " * 30, "en", None), (107, f"{prose(50)} a.b@c.de {prose(50)}", None, "s0"), (107, f"{prose(50)} a.b@c.de {prose(50)}", None, "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return f"file://{d}", rows, [(1, item)]


def test_stages_do_their_whole_job(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = [(r[0], r[1]) for r in rows if r[0] not in (104, 105, 106)]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        seen[name] = sorted((r.doc_id, r.text) for r in out.collect())
        docs = out
    assert seen["quality rules"] == sorted(left)
    root = grouped(range(len(left)), lambda a, b: (finger(left[a][1]) ^ finger(left[b][1])).bit_count() <= 2)
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(left[k])
    kept = sorted(min(g, key=lambda x: x[0]) for g in groups.values())
    near = seen["SimHash near-dedup"]
    assert {i for i, _ in near} <= {i for i, _ in kept} and len(near) == len(set(near)) and {101, 102}.isdisjoint(i for i, _ in near)
    bad = {x[0] for x in contaminated(near, items) if x[5]}
    assert 103 in bad and [i for i, _ in seen["benchmark decontamination"]] == [i for i, _ in near if i not in bad]
    for i, text in seen["PII"]:
        assert "@" not in text
        assert pii.base(text.encode()) == [] and (i != 107 or "[EMAIL]" in text)


def test_run_packs_what_the_stages_keep(spark, folder):
    d, rows, _ = folder
    out = corpus_pipeline.run(spark, d).collect()
    ids = {r.doc_id for r in out}
    assert ids.isdisjoint({101, 102, 103, 104, 105, 106}) and {0, 59, 100, 107} <= ids
    fill = defaultdict(int)
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_clean_documents_stay(spark):
    rows = [(k, prose(60 + k), "en", "s") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert quality.filtered(docs).count() == 50
    assert re.match("quality", corpus_pipeline.STAGES[0][0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_near_duplicates_of_the_tables_are_those_of_brute_force(spark):
    """All pairs of a thousand documents: five-word shingles, similarity of 0.8 and more, or fingerprints two bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    sets, fps = [simhash.shingles(t.encode()) for _, t in rows], [finger(t) for _, t in rows]
    holds = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    common = Counter((a, b) for ks in holds.values() for a, b in itertools.combinations(ks, 2))
    pairs = {(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9}
    assert len(pairs) > 20
    root = grouped(range(len(rows)), lambda a, b: (a, b) in pairs or (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {}
    for k, r in root.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(least.values())
