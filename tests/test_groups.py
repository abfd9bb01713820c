"""Groups of consecutive frames against a sequential splitter, with gaps; frame numbers and retries."""

import random

from frameledger.operators import catalog, packing


def sequential(rows, size):
    out, group = [], []
    for r in sorted(rows):
        if group and (r[:2] != group[-1][:2] or r[2] != group[-1][2] + 1 or r[3] != group[-1][3] or len(group) == size):
            out.append(group)
            group = []
        group.append(r)
    return sorted(map(tuple, out + [group]))


def test_groups_with_gaps(spark):
    rnd = random.Random(3)
    rows = [(f"r{r}", f"s{s}", n, rnd.choice([1, 1, 1, 2])) for r in range(3) for s in range(2) for n in range(60) if rnd.random() > 0.15]
    got = packing.groups(spark.createDataFrame(rows, "run string, stream string, frame_no long, width int"), 4).collect()
    held = {}
    for r in got:
        held.setdefault((r.run, r.stream, r.isl, r.part), []).append((r.run, r.stream, r.frame_no, r.width))
    assert sorted(tuple(sorted(g)) for g in held.values()) == sequential(rows, 4)


def test_frames_continue_behind_existing(spark):
    old = spark.createDataFrame([("a", "s", 0), ("a", "s", 1)], "run string, stream string, frame_no long")
    new = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, None, None)], "seq long, run string, stream string")
    assert {r.seq: r.new_frame_no for r in catalog.allocate_frames(new, old).collect()} == {1: 2, 2: 3, 3: 0, 4: None}


def test_activation_refuses_a_moved_member(spark):
    log = spark.createDataFrame([("i", 1, "png", "x", None), ("j", 1, "png", "y", None), ("j", 2, "png", "z", None)], "image_id string, representation_version int, representation_kind string, png_sha string, segment_id string")
    plan = spark.createDataFrame([("s", "i", 1, "x"), ("t", "j", 1, "y"), ("u", "gone", 1, "q")], "segment_id string, image_id string, representation_version int, png_sha string")
    assert {r.segment_id: r.moved for r in packing.activation(plan, log).collect()} == {"s": False, "t": True, "u": True}
