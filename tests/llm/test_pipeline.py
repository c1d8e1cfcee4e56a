from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from kpiforge.llm import quality, secrets
from kpiforge.llm.common import table, tokenizer_path, written
from tests.llm import test_decontam, test_probminhash
from tests.llm.fixtures import edge, empty
from tests.llm.test_packing import check_sequences

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    """Each stage's rows from its own input by plain Python."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = written(stage(spark, docs, SF), "test_stage")
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns
            after = [(r.doc_id, r.text) for r in rows]
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
            assert sorted(after) == sorted(x for x in before if x[0] in kept) and len(after) > 100
        elif name == "near_duplicates":
            heads = set(test_probminhash.brute(before).values())
            assert sorted(after) == sorted(x for x in before if x[0] in heads)
        elif name == "decontamination":
            bad = {r[0] for r in test_decontam.brute(before, bench) if r[5]}
            want = test_decontam.brute_clean(before, bench)
            assert bad and sorted(after) == sorted(want) and len(want) + len(bad) == len(before)
            assert set(want) - set(before)          # items below the share are cut out
        elif name == "secret_scan":
            found = {}
            for r in secrets.scan(docs).filter("is_secret").collect():
                found.setdefault(r.doc_id, []).append((r.start, r.candidate))
            want = []
            for d, t in before:
                for a, s in sorted(found.get(d, ()), reverse=True):     # from the end, so places stay
                    assert t[a:a + len(s)] == s
                    t = t[:a] + "[SECRET]" + t[a + len(s):]
                want.append((d, t))
            assert found and sorted(after) == sorted(want)
        else:
            slow = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
            want = {d: len(slow.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in before}
            got = Counter()
            for r in rows:
                got[r.doc_id] += r.length
            assert got == want
            assert check_sequences(rows, 1024) <= np.ceil(sum(want.values()) / 1024) + 2
        docs = out


def test_edges(spark):
    bench = SF
    for rows in (edge(spark), empty(spark)):
        docs = rows
        for name, stage in cp.STAGES:
            docs = written(stage(spark, docs, bench), "test_edge")
            assert name == "best_fit_packing" or docs.columns == rows.columns
