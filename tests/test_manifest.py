"""Requests as ranges of a shared store of texts, against all rows written out."""

import pytest
from pyspark.sql import functions as F

from labelloom.operators import manifest
from labelloom.sizing import local_frame

SCHEMA = "item_id bigint, text string, label string, outcome string"
ROWS = [
    (i, f"<{i}>" * (1 + i % 5) if i % 17 else "", ["hot", "hot", "b", "c", "only right"][i % 5], "wrong" if i % 3 == 0 and i % 5 != 4 else "correct")
    for i in range(120)
] + [(200, None, "b", "wrong"), (201, "x", None, "wrong"), (202, "late", "z", "wrong"), (203, None, None, "correct")]


def shown(spark, rows, block_chars=40):
    judged = local_frame(spark, rows, SCHEMA)
    blocks, groups = manifest.block_store(judged, block_chars, ids_per_fragment=4)
    return manifest.request_manifest(groups, judged), manifest.numbered_blocks(blocks, groups)


@pytest.mark.parametrize("block_chars", [1, 40, 100_000])
def test_ranges_show_every_text_once_per_class(spark, block_chars, monkeypatch):
    # spans of two fragments: sizes are carried over many of them
    monkeypatch.setattr(manifest, "FRAGMENTS_PER_SPAN", 2)
    ranges, numbered = shown(spark, ROWS, block_chars)
    store = {r.block: r for r in numbered.collect()}
    usable = [r for r in ROWS if r[1] is not None and r[2] is not None]
    assert sum(r.n_texts for r in store.values()) == len(usable)
    if block_chars == 40:
        longest = max(len(t) for _, t, _, _ in usable) * 4 + 8
        assert len(store) > 20 and all(r.n_chars <= 40 + longest for r in store.values())
    rows = ranges.collect()
    targets = {r.label for r in rows}
    assert targets == {"hot", "b", "c", "z"} and {r.n_unusable for r in rows} == {3}
    for label in targets:
        own = {(r.role, r.range_no): r for r in rows if r.label == label}
        assert len(own) <= 5
        seen = {}
        for (role, _), r in own.items():
            inside = [store[b] for b in range(r.first_block, r.end_block) if b in store]
            assert r.n_texts == sum(b.n_texts for b in inside) and r.n_chars == sum(b.n_chars for b in inside)
            seen.setdefault(role, []).extend(t for b in inside for t in b.body.split("\n\n"))
        want = {
            "cover": [t for _, t, l, o in usable if l == label and o == "wrong"],
            "covered": [t for _, t, l, o in usable if l == label and o == "correct"],
            "avoid": [t for _, t, l, _ in usable if l != label],
        }
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items() if v}
        # within its own class a request shows texts in the order of items
        assert seen["cover"] == want["cover"]


def test_prompts_are_written_out_block_by_block(spark):
    ranges, numbered = shown(spark, ROWS)
    prompts = manifest.rendered(ranges.filter("label = 'b'"), numbered, "demo", 2, None, "about tests").collect()
    assert len({p.block for p in prompts}) == len(prompts) == numbered.count()
    heads = {"cover": "Texts to cover", "covered": "Texts already covered", "avoid": "Texts to avoid"}
    bodies = {r.block: r.body for r in numbered.collect()}
    for p in prompts:
        assert "Class: b" in p.prompt and "about tests" in p.prompt and bodies[p.block] in p.prompt
        assert [h for h in heads.values() if h in p.prompt] == [heads[p.role]]


def test_edges(spark):
    assert [f.collect() for f in shown(spark, [])] == [[], []]
    # nothing to cover: nothing is asked
    assert shown(spark, [(0, "a", "x", "correct")])[0].isEmpty()
    # one class alone has nothing to avoid
    alone = shown(spark, [(0, "a", "x", "wrong"), (1, "", "x", "correct")])[0].collect()
    assert [(r.role, r.n_texts) for r in sorted(alone, key=lambda r: r.role)] == [("cover", 1), ("covered", 1)]
    # columns of other names are no matter
    more = local_frame(spark, ROWS, SCHEMA).withColumns({"part": F.lit(1), "body": F.lit("b"), "fragment": F.lit(0)})
    blocks, groups = manifest.block_store(more, 40, 4)
    assert manifest.request_manifest(groups, more).count() == shown(spark, ROWS)[0].count()
