"""Small hand-made cases."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import schema
from kindred.functions import arrays, nifti, text
from kindred.operators import catalogs, decisions, embedding, exact, files, pairs, reports, vectors, verify
from kindred.operators.graph import connected_components
from kindred.plans import audit, sinks
from kindred.plans.numbering import group_numbers, rank_by_hash, row_numbers
from kindred.plans.profile import Profiler
from kindred.sources import tables
from kindred.sources.config import read_config, resolve_stages
from kindred.streaming import incremental


def dups(spark, rows):
    return spark.createDataFrame([(*r[:4], r[4], r[4]) for r in rows], "group_id string, dataset string, subject_id string, session_id string, candidate string, resolved_path string")


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_random(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(49)] + [(300, 300)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges)


def test_components_empty_and_null(spark):
    assert connected_components(spark.createDataFrame([(1, None)], "a long, b long")).count() == 0


def test_numbering(spark, monkeypatch):
    df = spark.createDataFrame([(f"{i * 7919 % 1000:04x}",) for i in range(300)], "h string").distinct()
    want = {h: i + 1 for i, h in enumerate(sorted(r.h for r in df.collect()))}
    assert {r.h: r.n for r in rank_by_hash(df, "h", "n").collect()} == want
    monkeypatch.setattr("kindred.plans.numbering.SMALL_ROWS", 10)
    assert {r.h: r.n for r in row_numbers(df, ["h"], "n").collect()} == want


def test_categories_edge_cases(spark):
    rows = reports.base_rows(dups(spark, [
        ("g1", "a", "sub-1", "", "p1"), ("g1", "a", "sub-1", "", "p2"), ("g2", "a", "", "", "p3"), ("g2", "a", "", "", "p4"),
        ("g3", "a", "sub-1", "s1", "p5"), ("g3", "a", "sub-1", "s2", "p6"), ("g3", "b", "sub-2", None, "p7"), ("g4", "", "sub-9", "", "p8"), ("g4", "NA", "sub-9", "", "p9"),
    ]))
    groups = lambda df: sorted({r.group_id for r in df.collect()})
    assert groups(reports.within_sessions(rows)) == ["g1"]
    assert groups(reports.within_subjects(rows)) == ["g3"]
    assert groups(reports.across_datasets(rows)) == ["g3"]
    counts = {r.category: r.n_pairs for r in reports.pair_category_counts(rows).collect()}
    points = reports.pair_points(rows, reports.exact_axis(rows)).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in points} == {k: v for k, v in counts.items() if v}
    wide = reports.wide(reports.within_sessions(rows), ["group_id"], ["resolved_path"]).first()
    assert (wide.duplicate_1_resolved_path, wide.duplicate_2_resolved_path) == ("p1", "p2")


def test_reports_empty(spark):
    rows = reports.base_rows(schema.empty(spark, schema.DUPLICATES))
    assert [f(rows).count() for f in reports.CATEGORY.values()] == [0] * 4
    assert {r.n_pairs for r in reports.pair_category_counts(rows).collect()} == {0}


def test_duplicate_groups_excluded_and_null(spark):
    h = spark.createDataFrame([("/a/sub-1/x", "aa"), ("/a/Derivatives/x", "aa"), ("/b", "bb"), ("/c", "bb"), ("/d", None), ("/e", "")], "resolved_path string, can_hash string")
    cat = spark.createDataFrame([("d", "s", "", "/b", "/b")], schema.VALID)
    got = exact.duplicate_groups(h, cat, "T1w").orderBy("resolved_path").collect()
    assert [(r.group_id, r.dataset, r.resolved_path) for r in got] == [("can_hash:1", "d", "/b"), ("can_hash:1", "", "/c")]


def test_removed_prefers_exact(spark):
    d = dups(spark, [("g", "a", "s", "", "/1"), ("g", "a", "s", "", "/2")])
    cat = d.select(*schema.KEYS)
    errors = spark.createDataFrame([("/2", "E: x"), ("/1", "E: y")], schema.HASH_ERRORS)
    got = {r.resolved_path: r.remove_reason for r in exact.removed_all(d, errors, cat).collect()}
    assert got == {"/2": "EXACT_DUPLICATE", "/1": "HASH_FAILED"}


def test_hash_errors_are_rows(spark):
    def canonical(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.lower()

    items = spark.createDataFrame([("a", bytearray(b"X")), ("b", bytearray(b"x")), ("c", bytearray(b"bad"))], "resolved_path string, content binary")
    got = {r.resolved_path: r for r in exact.hash_items(items, canonical).collect()}
    assert got["a"].can_hash == got["b"].can_hash and got["c"].error == "ValueError: broken"


def test_paths_and_text(spark):
    df = spark.createDataFrame([("/d/ds/sub-1/ses-2/anat/sub-1_ses-2_run-03_T1w.nii.gz",), ("sub-1/x",), (None,), ("/ds/sub-x/f",)], "p string")
    got = [tuple(r.t) for r in df.select(text.path_parts("p").alias("t")).collect()]
    assert got == [("ds", "sub-1", "ses-2"), ("", "", ""), ("", "", ""), ("ds", "sub-x", "")]
    assert df.select(text.path_entities("p").alias("e")).first().e == {"sub": "1", "ses": "2", "run": "03"}
    odd = spark.createDataFrame([("/x/sub-1_odd-7_run-1_run-2-b_T1w.nii",)], "p string")
    assert odd.select(text.path_entities("p").alias("e")).first().e == {"sub": "1", "run": "2-b"}
    n = spark.createDataFrame([("sub-12a3",), ("sub-x",), (None,), ("9" * 30,)], "s string").select(text.natural_number("s").alias("n")).collect()
    assert [r.n for r in n] == [12, 10**9, 10**9, 10**9]


def test_classify_real_files(spark, tmp_path):
    good = tmp_path / "ds" / "sub-1" / "anat" / "sub-1_T1w.nii.gz"
    good.parent.mkdir(parents=True)
    good.write_bytes(b"x")
    other = tmp_path / "ds" / "sub-2" / "note.txt"
    other.parent.mkdir()
    other.write_text("y")
    (tmp_path / "ds" / "link_T1w.nii.gz").symlink_to(good)
    paths = [str(good), str(other), str(tmp_path / "none.nii"), str(tmp_path / "derivatives" / "a.nii"), str(tmp_path / "ds" / "link_T1w.nii.gz")]
    found = catalogs.classified(catalogs.probe_paths(spark.createDataFrame([(p,) for p in paths], "candidate string")))
    assert [r.status for r in found.collect()] == ["ok", "not_nifti", "missing", "excluded_dir", "ok"]
    assert catalogs.valid_catalog(found).count() == 1
    assert [r.candidate for r in tables.discover(spark, str(tmp_path), "T1w").collect()] == [str(good)]


def test_locators(spark):
    root = "/d/ds"
    paths = [f"{root}/sub-1/ses-2/anat/sub-1_ses-2_T1w.nii.gz", f"{root}/sub-1/ses-2/anat/sub-1_ses-2_run-2_T1w.nii.gz", f"{root}/sub-2/anat/other_T1w.nii.gz", f"{root}/sub-3/anat/a_T1w.nii.gz", f"{root}/sub-3/anat/b_T1w.nii.gz", f"{root}/sub-4/anat/x.txt"]
    seg = [f"{root}/sub-1/ses-2/TOOLv2/post/FinalResult/sub-1_ses-2_T1w_seg.nii.gz", f"{root}/sub-1/ses-2/OTHER/post/FinalResult/sub-1_ses-2_T1w_seg.nii.gz"]
    files_ = spark.createDataFrame([(p,) for p in paths + seg], "candidate string")
    subjects = spark.createDataFrame([(x,) for x in ("sub-1_ses-2", "sub-2", "sub-3", "sub-4", "ses-9", None)], "subject string")
    got = {r.subject: (r.status, r.path) for r in catalogs.locate_images(subjects, files_, root).collect()}
    assert got == {"sub-1_ses-2": ("ok", paths[0]), "sub-2": ("ok", paths[2]), "sub-3": ("several", None), "sub-4": ("missing", None), "ses-9": ("no_subject", None), None: ("no_subject", None)}
    found = {r.subject: (r.status, r.path) for r in catalogs.locate_segmentations(subjects, files_, root, "TOOL").collect()}
    assert found["sub-1_ses-2"] == ("ok", seg[0]) and found["sub-2"][0] == "missing" and found["ses-9"][0] == "no_subject"


def test_verify_flags(spark):
    rows = [("g", "a", 3, "h1", "c", [1.0, 2.0], "x"), ("g", "b.gz", 4, "h2", "c", [1.0, 2.00001], "x"), ("g", "c", 3, "h3", "z", [1.0, 9.0], "y"), ("g", "d", 3, "h4", "c", [1.0, 9.0], "y"), ("g", "e", 3, None, None, None, None)]
    m = spark.createDataFrame(rows, "group_id string, resolved_path string, n_bytes long, raw_hash string, can_hash string, qform array<double>, header_hash string")
    m = m.withColumn("sform", F.lit(None).cast("array<double>")).withColumn("raw_error", F.when(F.col("raw_hash").isNull(), "PERMISSION"))
    got = {r.resolved_path_j: r for r in verify.compared(verify.anchor_pairs(m)).collect()}
    assert {p: (r.raw_reason, r.category, r.flag_affine_meta_diff, r.flag_header_other_diff) for p, r in got.items()} == {
        "b.gz": ("DIFF_SIZE", "CAN_EQUAL_COMPRESSION_GZ", False, False), "c": ("DIFF_CONTENT", "DIFF_BYTES_AND_CAN_MISMATCH", False, False),
        "d": ("DIFF_CONTENT", "CAN_EQUAL_HEADER", True, False), "e": ("PERMISSION", "ERROR_LOADING", False, False),
    }
    g = verify.group_checks(m.where("raw_hash is not null")).first()
    assert (g.byte_identical_all, g.canonical_identical_all, g.witness) == (False, False, "b.gz")
    flags = verify.row_flags(verify.compared(verify.anchor_pairs(m))).first()
    assert flags.n_issues == 4 and flags.flag_affine_meta_diff and not flags.flag_orient_diff


def test_nifti(tmp_path):
    r = np.random.RandomState(1)
    v = r.randint(-50, 50, (3, 4, 5)).astype(np.int16)
    ras = np.diag([2.0, 2.0, 2.0, 1.0])
    one = nifti.inspect(nifti.build(v, ras, (2.0, 2.0, 2.0)))
    assert (one["shape"], one["dtype"], one["axcodes_original"], one["axcodes_canonical"], one["sform_code"], one["qform"]) == ([3, 4, 5], "int16", "RAS", "RAS", 1, None)
    assert one["can_hash"] == hashlib.sha256(v.astype("<f4").tobytes()).hexdigest()
    # the same voxels stored from left to right and with x and z exchanged
    turned = np.array([[0, 0, 2.0, 0], [0, 2.0, 0, 0], [-2.0, 0, 0, 8.0], [0, 0, 0, 1]])
    other = nifti.inspect(gzip.compress(nifti.build(np.ascontiguousarray(v[:, :, ::-1].transpose(2, 1, 0)), turned, (2.0, 2.0, 2.0))))
    assert other["can_hash"] == one["can_hash"] and other["value_hash"] == one["value_hash"] and (other["axcodes_original"], other["axcodes_canonical"]) == ("IAR", "RAS")
    # one volume of four dimensions, another type, NaN
    f = v.astype(np.float64)
    f[0, 0, 0] = np.nan
    four, three = nifti.inspect(nifti.build(f[..., None], ras)), nifti.inspect(nifti.build(f.astype(np.float32), ras))
    assert four["value_hash"] == three["value_hash"] != one["value_hash"] and four["can_hash"] == three["can_hash"]
    assert nifti.inspect(nifti.build(v.astype(np.int32), ras))["value_hash"] == one["value_hash"]
    two = nifti.inspect(nifti.build(np.stack([v, v + 1], -1), ras))
    assert two["can_hash"] == hashlib.sha256(v.astype("<f4").tobytes() + (v + 1).astype("<f4").tobytes()).hexdigest()
    scaled = nifti.inspect(nifti.build(v, ras, slope=2.0, inter=1.0))
    assert (scaled["slope"], scaled["inter"], scaled["dtype"]) == (2.0, 1.0, "float64") and scaled["value_hash"] == nifti.value_hash(v * 2.0 + 1)
    noted = nifti.inspect(nifti.build(v, ras, extensions=((6, b"note"), (4, b"x" * 20))))
    assert noted["extensions"] == "6:16,4:32" and noted["value_hash"] == one["value_hash"]
    for bad in (b"", b"x" * 400, nifti.build(v, ras)[:-1]):
        with pytest.raises(ValueError):
            nifti.inspect(bad)
    turn = nifti._rotation(0.0, 0.0, 1.0)
    assert np.allclose(turn, np.diag([-1, -1, 1])) and nifti.axis_codes(np.block([[turn, np.zeros((3, 1))], [np.zeros((1, 3)), np.ones((1, 1))]])) == "LPS"


def test_facts_of_files(spark, tmp_path):
    v = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(nifti.build(v, np.eye(4)))
    (tmp_path / "b.nii").write_bytes(b"broken")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.nii", "b.nii", "none.nii")], "resolved_path string")
    got = {r.resolved_path[-5:]: r for r in files.file_facts(paths, nifti.inspect).collect()}
    raw = hashlib.sha256(nifti.build(v, np.eye(4))).hexdigest()
    assert (got["a.nii"].raw_hash, got["a.nii"].error, got["a.nii"].shape) == (raw, None, [2, 3, 4])
    assert got["b.nii"].error.startswith("ValueError") and got["b.nii"].raw_hash and got["b.nii"].can_hash is None
    assert (got["e.nii"].raw_error, got["e.nii"].n_bytes) == ("MISSING", None)
    plain = {r.resolved_path[-5:]: r for r in files.file_facts(paths).collect()}
    assert plain["a.nii"].can_hash == plain["a.nii"].raw_hash == raw and plain["b.nii"].error is None


def neighbours(spark, rows):
    full = [(*["d" + str(q), f"s{q}", "", f"/{q}", f"/{q}", f"u{q}"], *["d" + str(c), f"s{c}", "", f"/{c}", f"/{c}", f"u{c}"], k, s) for q, c, k, s in rows]
    return spark.createDataFrame(full, schema.NEIGHBOURS)


def test_pairs_and_review(spark):
    n = neighbours(spark, [(1, 2, 1, 0.9), (2, 1, 3, 0.95), (1, 3, 2, 0.8), (4, 4, 1, 1.0), (3, 2, 1, 0.79)])
    p = pairs.scan_pairs(n, 0.8)
    got = {(r.scan_uid_a, r.scan_uid_b): (r.similarity, r.best_rank, r.n_directions) for r in p.collect()}
    assert got == {("u1", "u2"): (0.95, 1, 2), ("u1", "u3"): (0.8, 2, 1)}
    wide = pairs.review_wide(pairs.review_list(p, 1))
    assert wide.where("query_scan_uid = 'u1'").first().candidate_1_scan_uid == "u2"
    # a pair stays if either side's cap keeps it
    assert pairs.undirected(pairs.review_long(wide)).count() == 2
    assert pairs.review_list(p, 0).count() == 0


def test_decisions(spark):
    row = lambda a, b, q, s: ("d", "s" + a, "", a, "d", "s" + b, "", b, q, "", "", s)
    cols = [f"{c}_{i}" for i in (1, 2) for c in ("dataset", "subject_id", "session_id", "path")] + ["qa_status", "reason", "date", "seq"]
    log = spark.createDataFrame([row("b", "a", "Yes", 1), row("a", "b", "no", 2), row("a", "c", "yes", 1), row("c", "c", "yes", 1), row("a", "", "yes", 1), row("d", "e", "perhaps", 1), row("e", "f", "maybe", 1)], cols)
    got = {(r.path_1, r.path_2): r.qa_status for r in decisions.latest(log).collect()}
    assert got == {("a", "b"): "no", ("a", "c"): "yes", ("e", "f"): "maybe"}
    assert decisions.invalid(log).count() == 3
    assert [(r.subject_key_a, r.subject_key_b) for r in decisions.subject_edges(decisions.latest(log)).collect()] == [("d|sa", "d|sc")]
    assert decisions.pruned(decisions.latest(log), spark.createDataFrame([("a",), ("b",)], "path string")).count() == 1


def test_group_order(spark):
    e = [("d|1", "d|2"), ("x|1", "x|2"), ("c|1", "c|2"), ("c|2", "c|3")]
    edges = spark.createDataFrame(e, "subject_key_a string, subject_key_b string")
    got = sorted({(r.group_id, r.group_size, min(r.dataset, "z")) for r in decisions.subject_groups(edges).collect()})
    assert got == [("group_000001", 2, "d"), ("group_000002", 2, "x"), ("group_000003", 3, "c")]


def test_vectors_modes(spark):
    v = spark.createDataFrame([("a", "o", [1.0, 0.0]), ("b", "o", [1.0, 0.01]), ("c", "p", [0.9, 0.1]), ("d", "q", [0.0, 1.0]), ("e", "r", None)], "uid string, owner string, embedding array<float>")
    post = {(r.query, r.cand) for r in vectors.nearest(v, 1, "post").collect()}
    pre = {(r.query, r.cand) for r in vectors.nearest(v, 1, "pre").collect()}
    assert ("a", "c") not in post and ("a", "c") in pre and ("d", "c") in pre
    assert vectors.nearest(v.limit(0), 1).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        vectors.nearest(v.unionByName(spark.createDataFrame([("f", "s", [1.0])], v.schema)), 1).collect()


@pytest.mark.parametrize("mode", ["pre", "post"])
def test_nearest_in_blocks(spark, monkeypatch, mode):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "LEAST_QUERIES", 5)
    monkeypatch.setattr(vectors, "MOST_QUERIES", 5)
    monkeypatch.setattr(vectors, "ROWS", 3)
    r = np.random.RandomState(5)
    x = r.randint(-2, 3, (60, 4)).astype(float)  # with ties
    x[0] = 0
    rows = [(f"u{i:02d}", f"o{i % 9}", x[i].tolist()) for i in range(60)]
    v = spark.createDataFrame(rows, "uid string, owner string, embedding array<double>").repartition(5)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = np.round(unit @ unit.T, 12)
    want = set()
    for i in range(60):
        order = sorted((j for j in range(60) if mode == "post" or i % 9 != j % 9), key=lambda j: (-sims[i, j], j))
        kept = [j for j in order[: 5 if mode == "post" else 4] if i % 9 != j % 9][:4]
        want |= {(f"u{i:02d}", f"u{j:02d}", rank + 1) for rank, j in enumerate(kept)}
    assert {(q.query, q.cand, q.rank) for q in vectors.nearest(v, 4, mode).collect()} == want
    some = v.where("uid < 'u07'")
    assert {(q.query, q.cand, q.rank) for q in vectors.nearest(v, 4, mode, some).collect()} == {w for w in want if w[0] < "u07"}


def test_kernels():
    r = np.random.RandomState(3)
    vol = r.rand(4, 5, 6)
    out = arrays.winsorised_minmax(vol, vol > 0.2)
    assert out.min() == 0 and out.max() == 1 and (out[vol <= 0.2] == 0).all()
    assert (arrays.winsorised_minmax(np.ones((2, 2)), np.ones((2, 2))) == 0).all() and (arrays.winsorised_minmax(vol, np.zeros(vol.shape)) == vol.astype(np.float32)).all()
    assert arrays.crop_or_pad(vol, (6, 3, 6)).shape == (6, 3, 6)
    assert arrays.slice_stack(vol, 4, 2, 2, centre=0).shape[0] == 4 and arrays.slice_stack(vol, 9, 0).shape[0] == 4
    assert (arrays.slice_stack(vol[:3], 5, 0, centre=1) == vol[:3]).all()
    grey = lambda n, *shape: np.full(shape, n, np.uint8)
    assert arrays.difference_tile(grey(200, 2, 3), grey(0, 3, 2)).tolist() == [[[255, 0, 0]] * 2] * 2
    assert arrays.difference_tile(grey(0, 1, 1), grey(32, 1, 1))[0, 0].tolist() == [127, 127, 255] and arrays.difference_tile(grey(9, 1, 1), grey(9, 1, 1))[0, 0].tolist() == [255] * 3
    board = arrays.checkerboard_tile(grey(0, 32, 40), grey(1, 40, 32))
    assert board.shape == (32, 32, 3) and board[0, 16].tolist() == [1] * 3 and board[16, 16].tolist() == [0] * 3
    assert arrays.to_uint8(np.array([[0.0, 1.0]]))[..., 0].tolist() == [[0, 255]] and arrays.to_uint8(np.array([[-5.0, 5.0]]))[..., 0].tolist() == [[0, 254]]
    assert arrays.to_uint8(np.zeros((2, 2, 4), np.uint8)).shape == (2, 2, 3)
    assert [m.shape[:2] for m in arrays.mosaic_tiles(np.zeros((2, 7)))] == [(2, 2)] * 3 and arrays.mosaic_column(np.zeros((7, 2))).shape == (6, 2, 3)
    assert arrays.side_by_side([np.zeros((2, 1)), np.zeros((3, 2))]).shape == (3, 3)


def test_encoder_failures(spark):
    items = spark.createDataFrame([("u1", "ok"), ("u2", "bad"), ("u3", "odd")], "scan_uid string, resolved_path string")

    def pre(path):
        if path == "bad":
            raise OSError("gone")
        return path

    def enc(batch):
        if "odd" in batch:
            raise ValueError("shape")
        return [[3.0, 4.0]] * len(batch)

    got = {r.scan_uid: r for r in embedding.encode(items, pre, enc).collect()}
    assert got["u1"].embedding == pytest.approx([0.6, 0.8]) and got["u2"].stage == "preprocessing" and got["u3"].stage == "inference"
    assert embedding.pending(items, items.where("scan_uid = 'u1'")).count() == 2

    def load(path):
        if path == "odd":
            raise ValueError("empty")
        return path

    vectors_ = {"ok": [3.0, 4.0], "nan": [float("nan"), 1.0], "long": [1.0, 2.0, 3.0]}
    more = items.unionByName(spark.createDataFrame([("u4", "nan"), ("u5", "long")], items.schema))
    got = {r.scan_uid: r.stage for r in embedding.encode(more, pre, lambda batch: [vectors_[p] for p in batch], load=load, length=2).collect()}
    assert got == {"u1": None, "u2": "preprocessing", "u3": "preprocessed_tensor_load", "u4": "embedding_persist", "u5": "embedding_persist"}
    with pytest.raises(Exception, match="(preprocessing of u2|inference of u3) failed"):
        embedding.encode(items, pre, enc, fail_fast=True).collect()


def test_embedding_resumes(spark, tmp_path):
    items = spark.createDataFrame([("d", "s", "", n, n, f"u{n}") for n in "abc"], schema.NEAR_INPUT)
    out, profiler = str(tmp_path / "emb"), Profiler()

    def encoder(batch):
        if "c" in batch:
            raise ValueError("no c yet")
        return [[1.0, 0.0]] * len(batch)

    assert audit.run_embedding(spark, items, out, str, encoder, profiler).count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{out}/failures").collect()] == [("uc", "inference", "ValueError: no c yet")]
    odd = spark.createDataFrame([("ua", [1.0], None, None), ("ub", [float("nan"), 1.0], None, None)], "scan_uid string, embedding array<float>, stage string, error string")
    sinks.append_table(odd, f"{out}/parts")  # rows of no use
    (tmp_path / "emb" / "parts" / "part-broken.parquet").write_bytes(b"PAR1 cut off")
    found = audit.run_embedding(spark, items, out, str, lambda batch: [[0.0, 1.0]] * len(batch), profiler)
    assert sorted((r.scan_uid, r.emb_row) for r in found.collect()) == [("ua", 0), ("ub", 1), ("uc", 2)]
    assert spark.read.parquet(f"{out}/failures").count() == 0
    assert [(r.n_pending, r.n_embedded, r.n_failed) for r in profiler.details(spark).collect()] == [("3", "2", "1"), ("1", "3", "0")]
    assert tables.read_failures(spark, str(tmp_path / "none.csv")).count() == 0


def test_requests_must_agree(spark):
    n = neighbours(spark, [(1, 2, 1, 0.9)])
    listed = pairs.review_long(pairs.review_wide(pairs.review_list(pairs.scan_pairs(n, 0.5))))
    requests = pairs.scan_requests(listed)
    manifest = n.select(*[F.col(f"query_{c}").alias(c) for c in pairs.META]).unionByName(n.select(*[F.col(f"cand_{c}").alias(c) for c in pairs.META]))
    assert pairs.checked_requests(requests, manifest).count() == 2
    with pytest.raises(ValueError, match="u2 not in manifest"):
        pairs.checked_requests(requests, manifest.where("scan_uid = 'u1'"))
    with pytest.raises(ValueError, match="dataset differs"):
        pairs.checked_requests(requests, manifest.withColumn("dataset", F.lit("q")))
    assert [tuple(r) for r in pairs.pair_requests(listed).collect()] == [("u1", "u2", "u1__u2")]
    assert tuple(pairs.plan_totals(pairs.asset_plan(requests, manifest.limit(1))).first()) == (2, 1, 1)


def test_large_groups_are_numbered_by_range(spark, monkeypatch):
    rows = [("big", f"{i * 7919 % 1000:04d}", None if i % 2 else "x") for i in range(300)] + [(None, f"{i}", "") for i in range(30)] + [("small", "b", ""), ("small", "a", "")]
    df = spark.createDataFrame(rows, "g string, o string, p string")
    monkeypatch.setattr("kindred.plans.numbering.SMALL_ROWS", 20)
    got = {(r.g, r.o): r.n for r in group_numbers(df, ["g"], ["o"], "n").collect()}
    want = {(g, o): i + 1 for g in {r[0] for r in rows} for i, o in enumerate(sorted(r[1] for r in rows if r[0] == g))}
    assert got == want


def test_csv_round_trip(spark, tmp_path):
    d = schema.empty(spark, schema.VALID)
    sinks.write_csv(d, str(tmp_path / "empty.csv"))
    assert (tmp_path / "empty.csv").read_text().strip() == ",".join(schema.VALID.fieldNames())
    assert tables.read_csv_or_empty(spark, str(tmp_path / "none.csv"), schema.VALID).count() == 0
    rows = spark.createDataFrame([("NA", "s,1", None, 'c"q', "p")], schema.VALID)
    sinks.write_csv(rows, str(tmp_path / "one.csv"), ("dataset",))
    assert tuple(tables.read_csv(spark, str(tmp_path / "one.csv"), schema.VALID).first()) == ("NA", "s,1", "", 'c"q', "p")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_csv(spark, str(tmp_path / "one.csv"), schema.HASHES)
    with pytest.raises(ValueError, match="not unique"):
        schema.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), "k")
    with pytest.raises(ValueError, match="0.."):
        schema.require_dense(spark.createDataFrame([(1,), (2,)], "emb_row long"))


def test_pipeline_end_to_end(spark, tmp_path):
    for name, data in {"sub-1": b"one", "sub-2": b"one", "sub-3": b"two"}.items():
        f = tmp_path / "in" / "ds" / name / "anat" / f"{name}_T1w.nii.gz"
        f.parent.mkdir(parents=True)
        f.write_bytes(data)
    cfg = tmp_path / "c.toml"
    cfg.write_text(f'[run]\nout_dir = "{tmp_path}/out"\nstages = ["near", "exact"]\n[exact]\nroot = "{tmp_path}/in"\nverify = true\n[near]\nmin_similarity = 0.5\ntopk = 2\nuse_ivf = false\n')
    embed = lambda items: items.select("scan_uid", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>").alias("embedding"))
    profiler = audit.run_pipeline(spark, str(cfg), embed)
    assert [r.status for r in profiler.records] == ["ok"] * len(profiler.records)
    assert spark.read.parquet(f"{tmp_path}/out/exact/duplicates").count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/near/pairs").count() == 1
    assert {r.scan_uid for r in spark.read.parquet(f"{tmp_path}/out/near/input").collect()} == {hashlib.sha256(b).hexdigest() for b in (b"one", b"two")}
    checks = spark.read.parquet(f"{tmp_path}/out/exact/verified/within_datasets_with_checks").collect()
    assert [(r.byte_identical_all, r.canonical_identical_all, r.flag_orient_diff) for r in checks] == [("TRUE", "TRUE", False)] * 2 and all(r.mtime for r in checks)
    assert spark.read.parquet(f"{tmp_path}/out/near/scan_requests").count() == 2 and spark.read.parquet(f"{tmp_path}/out/near/pair_requests").count() == 1
    assert (tmp_path / "out" / "near" / "review_candidates.csv").read_text().startswith("query_dataset")
    assert next(r for r in profiler.records if r.stage_name == "exact_hash_group").n_output == 2
    audit.run_pipeline(spark, str(cfg), embed)  # resumes: nothing is hashed again
    assert spark.read.parquet(f"{tmp_path}/out/exact/hashes").count() == 3
    assert resolve_stages(["near", "exact", "near"]) == ("exact", "near")
    with pytest.raises(ValueError):
        resolve_stages(["other"])
    cfg.write_text('[run]\nout_dir = "x"\n[exact]\nroot = "a"\nvalid_csv = "b"\n')
    with pytest.raises(ValueError, match="exactly one"):
        read_config(str(cfg))


def test_finalise_and_profile(spark, tmp_path):
    cols = [f"{c}_{i}" for i in (1, 2) for c in ("dataset", "subject_id", "session_id", "path")] + ["qa_status", "reason", "date", "seq"]
    log = spark.createDataFrame([("d", "s1", "", "a", "d", "s2", "", "b", "yes", "", "", 1)], cols)
    got = audit.finalise(spark, log, str(tmp_path / "f"))
    assert got["groups"].count() == 2 and spark.read.parquet(f"{tmp_path}/f/within_datasets").count() == 2
    assert spark.read.parquet(f"{tmp_path}/f/within_datasets_stats").first().n_subjects == 2 and spark.read.parquet(f"{tmp_path}/f/pair_points").count() == 1
    # an exported file leads to the same groups
    export = decisions.exported(decisions.latest(log))
    assert export.columns == [*[f"{c}_{i}" for i in (1, 2) for c in ("dataset", "subject_id", "session_id", "path")], "QA_status", "reason", "date"]
    sinks.write_csv(export, str(tmp_path / "review_decisions.csv"), ("path_1", "path_2"))
    again = audit.finalise(spark, tables.read_decisions(spark, str(tmp_path / "review_decisions.csv")), str(tmp_path / "g"))
    assert sorted(map(tuple, again["groups"].collect())) == sorted(map(tuple, got["groups"].collect()))
    p = Profiler()
    with pytest.raises(RuntimeError), p.stage("total_pipeline"), p.stage("inner"):
        raise RuntimeError("x")
    assert [(r.stage_name, r.status, r.depth) for r in p.stages(spark).collect()] == [("total_pipeline", "failed", 0), ("inner", "failed", 1)]


def test_streaming(spark, tmp_path):
    src, out, log = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "log")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(src)
    stream = spark.readStream.schema("k string, s long, ts timestamp").parquet(src)
    q = incremental.first_seen(stream, "k", "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]
    q = stream.writeStream.foreachBatch(lambda b, e: incremental.apply_decisions(b, e, log)).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(log).count() == 3


def test_scratch_tables_go(spark):
    from pathlib import Path

    from kindred.plans.stored import scratched, stored

    seen = []

    def there(t):
        return Path(t._stored_path.removeprefix("file:")).exists()

    @scratched
    def inner():
        seen.append(stored(spark.range(2), "inner"))
        return stored(seen[-1].selectExpr("id + 1 as id"), "result")

    @scratched
    def outer(fail=False):
        first = inner()
        assert there(first) and not there(seen[-1])
        seen.append(first)
        if fail:
            raise KeyError("x")
        out = first.where("id > 1")
        out._reads = [first]
        return out

    assert [r.id for r in outer().collect()] == [2] and there(seen[-1])
    with pytest.raises(KeyError):
        outer(True)
    assert not there(seen[-1])


def test_cache_follows_inputs(spark, tmp_path):
    from kindred.plans.cache import cached, fingerprint

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i long, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i long, s string")
    assert fingerprint(a) == fingerprint(b) != fingerprint(b.where("i = 1")) and fingerprint(a) != fingerprint(a, params={"k": 1})
    built = []

    def build(df):
        built.append(1)
        return df

    assert cached(lambda: build(a), str(tmp_path), a).count() == 2
    assert cached(lambda: build(a), str(tmp_path), b).count() == 2 and len(built) == 1
