import json
import sys
import types

import numpy as np
import pytest

from pairloom import runlog
from pairloom.functions import normalise_extensions, plural
from pairloom.functions.text import split_extensions
from pairloom.operators.encode import HashEncoder, OpenClipEncoder, batched, encode
from pairloom.plans import RunConfig, cli, run
from pairloom.plans.anonymise import anonymise
from pairloom.plans.evaluate import evaluate
from pairloom.sources import json_files, scan, tables


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    for name in ("a.jpg", "nested/b.JPG", "nested/c.png", "d.png", "_e.png", "skip.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    (root / "empty.png").touch()
    return root


def test_scan_order_and_extensions(folder):
    names = [p.relative_to(folder).as_posix() for p in scan.find_files(folder)]
    assert names == ["_e.png", "a.jpg", "d.png", "empty.png", "nested/b.JPG", "nested/c.png"]


def test_index_follows_components(spark):
    paths = ["/r/a/z.png", "/r/a-b.png", "/r/a.png", "/q.png"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in scan.with_index(df).orderBy("idx").collect()] == ["/q.png", *paths[:3]]
    assert sorted(r.idx for r in scan.with_index(df).collect()) == [0, 1, 2, 3]


def test_small_helpers():
    assert plural(1, "image") == "1 image" and plural(0, "image") == "0 images"
    assert normalise_extensions((".JPG", "png", "JPG", "bmp", "PNG")) == (".jpg", ".png", ".bmp")
    assert split_extensions(" jpg, ,.PNG") == (".jpg", ".png")
    assert [list(b) for b in batched([1, 2, 3, 4], 2)] == [[1, 2], [3, 4]]
    assert [list(b) for b in batched([1, 2, 3], 4)] == [[1, 2, 3]] and list(batched([], 3)) == []
    with pytest.raises(ValueError):
        batched([1], 0)


def test_log_hides_private_lines(tmp_path, capsys):
    runlog.configure(tmp_path / "x" / "run.log")
    runlog.log("kept")
    runlog.log("private", to_file=False)
    runlog.configure(None)
    assert "kept" in (tmp_path / "x" / "run.log").read_text() and "private" not in (tmp_path / "x" / "run.log").read_text()
    assert "private" in capsys.readouterr().out


@pytest.mark.parametrize("bad", [{"pairwise_dtype": "float64"}, {"top_k": 0}, {"batch_size": 0}, {"input_dir": "/no/such/dir"}])
def test_config_rejects(folder, tmp_path, bad):
    with pytest.raises(ValueError):
        RunConfig(**{"input_dir": folder, "output_dir": tmp_path / "out"} | bad)


def test_encoder_keeps_order_and_closes(spark):
    closed = []

    class Stub(HashEncoder):
        def encode(self, batch):
            return np.array([[2.0 * len(x)] for x in batch])

    rows = spark.createDataFrame([(0, bytearray(b"a")), (1, bytearray(b"bcd"))], "idx bigint, content binary")
    assert [(r.idx, r.embedding) for r in encode(rows, Stub, 1).orderBy("idx").collect()] == [(0, [2.0]), (1, [6.0])]
    assert not closed


def write_labels(tmp_path, groups):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps(groups))
    return path


@pytest.mark.parametrize("top_k", [None, 3])
@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_run_and_evaluate_end_to_end(spark, folder, tmp_path, top_k, dtype):
    marked = write_labels(tmp_path, {"z": [str(folder / "a.jpg"), str(folder / "d.png")], "y": [str(folder / "nested/b.JPG"), str(folder / "d.png"), str(folder / "_e.png")]})
    out = tmp_path / "out"
    config = RunConfig(input_dir=folder, output_dir=out, top_k=top_k, pairwise_dtype=dtype, labels_path=marked)
    npz = run(spark, config, lambda: HashEncoder(8))
    paths = json.loads((out / "image_paths.json").read_text())
    assert len(paths) == 6 and json.loads((out / "series_to_indices.json").read_text()) == {"z": [1, 2], "y": [4, 2, 0]}
    assert json.loads((out / "config.json").read_text())["top_k"] == top_k
    vectors = HashEncoder(8).encode([open(p, "rb").read() for p in paths]).astype(float)
    d = (1 - vectors @ vectors.T).astype(np.float32).astype(dtype)
    with np.load(npz) as data:
        if top_k is None:
            assert data["distances"].dtype == dtype
            assert np.allclose(data["distances"], d[np.triu_indices(6, 1)], atol=1e-3)
        else:
            np.fill_diagonal(d, np.inf)
            assert data["indices"].dtype == np.uint16 and data["distances"].shape == (6, 3)
            assert np.allclose(data["distances"], np.sort(d, axis=1)[:, :3], atol=1e-3)
    source = {"topk": npz} if top_k else {"distances": npz}
    evaluate(spark, out / "map.csv", series_indices=out / "series_to_indices.json", **source)
    first = (out / "map.csv").read_bytes()
    assert first.startswith(b"series,map@1,map@2,map@3\r\nz,") and b"\r\nmean," in first
    evaluate(spark, out / "map2.csv", labels_path=marked, image_paths=out / "image_paths.json", **source)
    assert (out / "map2.csv").read_bytes() == first
    # the Parquet table beside the exchange file gives the same report
    stored = out / "evaluation_results" / ("pairwise_topk" if top_k else "pairwise_distances")
    evaluate(spark, out / "map3.csv", series_indices=out / "series_to_indices.json", **{("topk" if top_k else "distances"): stored})
    assert (out / "map3.csv").read_bytes() == first
    with pytest.raises(FileExistsError):
        run(spark, config, lambda: HashEncoder(8))


def test_run_guards_come_before_work(spark, folder, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(FileNotFoundError):
        run(spark, RunConfig(input_dir=folder, output_dir=out, labels_path=tmp_path / "none.json"))
    with pytest.raises(RuntimeError, match="no images"):
        run(spark, RunConfig(input_dir=folder, output_dir=out, image_exts=("gif",)))
    with pytest.raises(ValueError, match="less than"):
        run(spark, RunConfig(input_dir=folder, output_dir=out, top_k=6))
    bad = write_labels(tmp_path, {"s": ["/missing/x.png"]})
    with pytest.raises(ValueError, match="/missing/x.png"):
        run(spark, RunConfig(input_dir=folder, output_dir=out, labels_path=bad))
    assert not out.exists()


def test_overwrite_removes_the_other_form(spark, folder, tmp_path):
    out = tmp_path / "out"
    run(spark, RunConfig(input_dir=folder, output_dir=out), lambda: HashEncoder(4))
    run(spark, RunConfig(input_dir=folder, output_dir=out, top_k=2, overwrite=True), lambda: HashEncoder(4))
    assert {p.name for p in (out / "evaluation_results").glob("*.npz")} == {"pairwise_topk.npz"}


@pytest.mark.parametrize("data", ["[]", '{"s": "x"}', '{"s": [1]}', '{"s": [["x"]]}'])
def test_malformed_labels(spark, tmp_path, data):
    path = tmp_path / "l.json"
    path.write_text(data)
    with pytest.raises(ValueError):
        json_files.read_labels(spark, path)
    with pytest.raises(Exception, match="labels must be"):
        json_files.read_labels_distributed(spark, str(path)).collect()


def test_both_label_readers_agree(spark, tmp_path):
    path = write_labels(tmp_path, {"z": ["/a", "/b"], "a": ["/b"]})
    one, two = json_files.read_labels(spark, path).collect(), json_files.read_labels_distributed(spark, str(path)).collect()
    assert [tuple(r) for r in one] == [(r.series, r.series_ord, r.pos, r.path) for r in two]


@pytest.mark.parametrize("data", ["[]", '{"s": 1}', '{"s": ["1"]}', '{"s": [true]}'])
def test_malformed_series_indices(spark, tmp_path, data):
    path = tmp_path / "s.json"
    path.write_text(data)
    with pytest.raises(ValueError):
        json_files.read_series_indices(spark, path)


def test_anonymise(spark, tmp_path):
    (tmp_path / "image_paths.json").write_text(json.dumps(["/i/a.png", "/i/b.png", "/i/c.png"]))
    marked = write_labels(tmp_path, {"series1": ["/i/a.png", "/i/b.png"], "series2": ["/i/c.png"]})
    assert anonymise(spark, tmp_path, marked) == {"series1": [0, 1], "series2": [2]}
    with pytest.raises(FileExistsError):
        anonymise(spark, tmp_path, marked)
    cli.main(["anonymize-labels", "-o", str(tmp_path), "-l", str(marked), "--overwrite"], spark)
    with pytest.raises(FileNotFoundError):
        anonymise(spark, tmp_path / "other", marked)
    with pytest.raises(FileNotFoundError):
        anonymise(spark, tmp_path, tmp_path / "none.json", overwrite=True)
    (tmp_path / "image_paths.json").write_text("{}")
    with pytest.raises(ValueError):
        anonymise(spark, tmp_path, marked, overwrite=True)


def test_evaluate_needs_one_source_and_labels(spark, tmp_path):
    for bad in ({}, {"distances": "x", "topk": "y", "series_indices": "z"}, {"distances": "x"}, {"distances": "x", "labels_path": "y"}):
        with pytest.raises(ValueError):
            evaluate(spark, tmp_path / "m.csv", **bad)


def test_npz_checks(spark, tmp_path):
    x = tmp_path / "x.npz"
    np.savez(x, distances=np.array([1, 2, 3], np.float32), stray=1)
    assert tables.load_packed_npz(spark, x)[1] == 3
    for bad in ({"other": [1.0]}, {"distances": np.ones((2, 2), np.float32)}, {"distances": np.ones(3)}, {"distances": np.ones(2, np.float32)}):
        np.savez(x, **bad)
        with pytest.raises((KeyError, ValueError)):
            tables.load_packed_npz(spark, x)
    good = {"indices": np.array([[1], [0]], np.uint16), "distances": np.ones((2, 1), np.float32), "top_k": 1, "dtype": "float32", "index_dtype": "uint16"}
    np.savez(x, **good)
    assert tables.load_topk_npz(spark, x)[1:] == (2, 1)
    for bad in ({"top_k": 2}, {"dtype": "float16"}, {"index_dtype": "uint32"}, {"indices": np.ones((2, 1))}, {"distances": np.ones((2, 1))}, {"distances": np.ones((1, 1), np.float32)}):
        np.savez(x, **good | bad)
        with pytest.raises(ValueError):
            tables.load_topk_npz(spark, x)
    np.savez(x, **{k: v for k, v in good.items() if k != "top_k"})
    with pytest.raises(KeyError):
        tables.load_topk_npz(spark, x)


def test_parquet_tables(spark, tmp_path):
    stored = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "pos bigint, dist float")
    tables.write_packed(stored, str(tmp_path / "p"))
    assert tables.read_packed(spark, str(tmp_path / "p"))[1] == 3
    with pytest.raises(Exception, match="exists"):
        tables.write_packed(stored, str(tmp_path / "p"))
    top = spark.createDataFrame([(0, 1, 1, 0.5), (1, 1, 0, 0.5)], "i bigint, rk int, j bigint, dist float")
    tables.write_topk(top, str(tmp_path / "t"), "float32", "uint16")
    _, k, meta = tables.read_topk(spark, str(tmp_path / "t"))
    assert k == 1 and meta == {"dtype": "float32", "index_dtype": "uint16"}


@pytest.mark.parametrize("top_k", [None, 2])
def test_run_without_exchange_file(spark, folder, tmp_path, top_k):
    out = tmp_path / "out"
    where = run(spark, RunConfig(input_dir=folder, output_dir=out, top_k=top_k, npz=False), lambda: HashEncoder(4))
    assert not list((out / "evaluation_results").glob("*.npz"))
    assert spark.read.parquet(where).count() == (15 if top_k is None else 12)


@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_exchange_files_in_parts(spark, tmp_path, monkeypatch, dtype):
    monkeypatch.setattr(tables, "PART_ROWS", 4)
    flat = spark.range(10).selectExpr("id AS pos", "cast(id / 7 AS float) AS dist").repartition(3)
    tables.save_packed_npz(flat, tmp_path / "p.npz", dtype)
    with np.load(tmp_path / "p.npz") as data:
        assert data["distances"].dtype == dtype and str(data["dtype"]) == dtype
        assert np.array_equal(data["distances"], (np.arange(10) / 7).astype(np.float32).astype(dtype))
    tables.save_packed_npz(flat, tmp_path / "q.npz", dtype, tag=False)
    assert np.load(tmp_path / "q.npz").files == ["distances"]
    top = spark.range(14).selectExpr("id div 2 AS i", "cast(id % 2 + 1 AS int) AS rk", "(id div 2 + id % 2 + 1) % 7 AS j", "cast(id AS float) AS dist").repartition(3)
    tables.save_topk_npz(top, tmp_path / "t.npz", dtype)
    table, n, k = tables.load_topk_npz(spark, tmp_path / "t.npz")
    assert (n, k) == (7, 2) and sorted(map(tuple, table.collect())) == sorted(map(tuple, top.collect()))


def test_items_from_a_store(spark, folder):
    items = scan.items_from_store(spark, folder.as_uri())
    names = [r.path.rpartition("/in/")[2] for r in items.orderBy("idx").collect()]
    assert names == ["a.jpg", "d.png", "nested/b.JPG", "nested/c.png"]
    contents = {r.idx: bytes(r.content) for r in scan.read_binary_from_store(spark, folder.as_uri(), items).collect()}
    assert contents == {0: b"a.jpg", 1: b"d.png", 2: b"nested/b.JPG", 3: b"nested/c.png"}


def test_image_encoder_decodes_with_its_libraries(monkeypatch):
    """With stand-ins for the libraries: images are decoded, made RGB, preprocessed and stacked, without gradients,
    and the model leaves memory at the end."""
    seen = []

    class Tensor(list):
        def __getattr__(self, name):
            return lambda *_: self

        def numpy(self):
            return np.array([list(x) for x in self], np.float32)

    class Image:
        def __init__(self, raw):
            self.raw = raw

        def convert(self, mode):
            seen.append(mode)
            return self

    class Model:
        def to(self, device):
            seen.append(device)

        def eval(self):
            seen.append("eval")

        def encode_image(self, batch):
            return Tensor([x * 2 for x in row] for row in batch)

    class NoGrad:
        def __enter__(self):
            seen.append("no_grad")

        def __exit__(self, *_):
            pass

    def create(model_id):
        seen.append(model_id)
        return Model(), lambda image: [float(len(image.raw))]

    torch = types.SimpleNamespace(no_grad=NoGrad, stack=Tensor, cuda=types.SimpleNamespace(is_available=lambda: False, empty_cache=lambda: seen.append("freed")))
    pil = types.SimpleNamespace(Image=types.SimpleNamespace(open=lambda f: Image(f.read())))
    for name, module in (("torch", torch), ("open_clip", types.SimpleNamespace(create_model_from_pretrained=create)), ("PIL", pil), ("PIL.Image", pil.Image)):
        monkeypatch.setitem(sys.modules, name, module)
    encoder = OpenClipEncoder("some-model")
    assert encoder.encode([b"one", b"four!"]).tolist() == [[6.0], [10.0]]
    assert seen == ["some-model", "cpu", "eval", "no_grad", "RGB", "RGB"]
    encoder.close()
    assert encoder.model is None and "freed" not in seen
    on_gpu = OpenClipEncoder("some-model", "cuda")
    on_gpu.close()
    assert seen[-1] == "freed"


def test_command_line_config(folder, tmp_path):
    args = cli.parser().parse_args(["run", "-i", str(folder), "-o", str(tmp_path / "o"), "--image-exts", "JPG, png", "--top-k", "2"])
    config = cli.config_from(args)
    assert config.image_exts == (".jpg", ".png") and config.top_k == 2 and config.batch_size == 32


def test_streamed_neighbours_equal_batch(spark, tmp_path):
    from pairloom.streaming import neighbours_against, stream_neighbours

    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((12, 3)))]
    schema = "idx bigint, embedding array<float>"
    index, new = spark.createDataFrame(rows[:8], schema), spark.createDataFrame(rows[8:], schema)
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream_neighbours(stream, index, 2, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    streamed = {(r.i, r.rk, r.j) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {(r.i, r.rk, r.j) for r in neighbours_against(new, index, 2).collect()} and len(streamed) == 8
