"""Components of reads by prefix k-mers, found among kinds of reads."""

from __future__ import annotations

import random

from strandlake.operators import demux
from strandlake.plans import components


def test_work_on_components_follows_prefixes_and_not_reads(spark, monkeypatch):
    rng = random.Random(8)
    heads = ["".join(rng.choices("ACGT", k=12)) for _ in range(20)]
    heads += [h[1:11] + rng.choice("ACGT") + "A" for h in heads[:6]]  # tied to the heads they come from
    rows = [(i, rng.choice(heads) + "".join(rng.choices("ACGTN", k=5))) for i in range(2_000)]
    rows += [(3_000, "ACGT"), (3_001, None), (3_002, "ACNTACGTACGTAC"), (3_003, heads[0]), (3_003, heads[19].lower()), (None, heads[1] + "A")]
    seen = []
    monkeypatch.setattr(demux, "connected_components", lambda edges, *a, **k: seen.append(edges.count()) or components.connected_components(edges, *a, **k))
    got = [(r.node, r.component) for r in demux.demux_clusters(spark.createDataFrame(rows, "read_id long, sequence string").repartition(7)).collect()]
    up = {i: i for i, _ in rows if i is not None}
    by = {}
    for i, s in rows:
        for w in ({s.upper()[j : j + 10] for j in range(2)} if i is not None and s and len(s) >= 12 else ()):
            if "N" not in w:
                by.setdefault(w, set()).add(i)
    changed = True
    while changed:
        changed = False
        for ids in by.values():
            low = min(up[i] for i in ids)
            changed |= any(up[i] != low for i in ids)
            up.update(dict.fromkeys(ids, low))
    assert len(got) == len(up) and dict(got) == up
    assert seen[0] <= 60  # two edges for each different prefix, before two for each of 2 000 reads
