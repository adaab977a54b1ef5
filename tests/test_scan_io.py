"""File-tree scan (A1, A2), decode chain (B3, B4) and writers."""

import os

import pytest
from pyspark.sql import functions as F

from revlens.sources.corpus_tree import decode_text, is_binary, read_paths, readable, scan_corpus, scan_file, write_tree


# bytes and the text they stand for (None: binary)
DECODED = [
    (b"", ""), (b"plain", "plain"), ("é".encode(), "é"), (b"\xef\xbb\xbfhello", "\ufeffhello"),
    (b"caf\xe9", "café"), (b"\x80\x9f", "€Ÿ"), (b"\x93q\x94", "“q”"), (b"\xff\xfe", "ÿþ"),
    (b"\xed\xa0\x80", "í\xa0€"), (b"x\x81y\x8dz", "x\x81y\x8dz"), (b"\x80\x81", "\x80\x81"),
    (b"\x8f\x90\x9d", "\x8f\x90\x9d"), (b"abc\x00def", None), (b"a" * 9000 + b"\x00", "a" * 9000 + "\x00"),
]
TREE_TEXT = {"cp.txt": "café €", "bom.md": "\ufeffhello", "undef.txt": "x\x81y\x8dz"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("trees") / "myproj"
    files = {
        "a.py": b"print('hi')\n",
        "pkg/__init__.py": b"",
        "pkg/_part.scss": b"$x: 1;",
        ".eslintrc.json": b"{}",
        ".git/x.py": b"hidden dir",
        "node_modules/z.js": b"ignored",
        "build/out.js": b"ignored",
        "Dockerfile": b"FROM scratch\n",
        "Thumbs.db": b"junk",
        "x.bin": b"binary suffix",
        "nul.txt": b"abc\x00def",
        "late_nul.txt": b"a" * 9000 + b"\x00",
        "cp.txt": "café €".encode("cp1252"),
        "bom.md": b"\xef\xbb\xbfhello",
        "undef.txt": b"x\x81y\x8dz",
        "empty.txt": b"",
        "UPPER.PY": b"x = 1",
    }
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root, files


def test_scan_tree(spark, tree):
    root, files = tree
    rows = {r["relative"]: r for r in scan_corpus(spark, str(root)).collect()}
    assert set(rows) == {"a.py", "pkg/__init__.py", "pkg/_part.scss", ".eslintrc.json", "Dockerfile",
                         "late_nul.txt", "cp.txt", "bom.md", "undef.txt", "empty.txt", "UPPER.PY"}
    for rel, r in rows.items():
        assert r["text"] == (TREE_TEXT[rel] if rel in TREE_TEXT else files[rel].decode()), rel
        assert r["project"] == "myproj"
        text = r["text"]
        assert r["lines"] == text.count("\n") + (1 if text else 0)
        assert r["tokens"] == max(1, round(len(text) / 3.5))
        assert r["size"] == len(files[rel])
    assert rows["bom.md"]["text"].startswith("﻿")          # utf-8 keeps the BOM


def test_decode(spark):
    import random
    rnd = random.Random(7)
    alphabet = "aé€“日😀\n"
    valid = ["".join(rnd.choices(alphabet, k=rnd.randrange(40))) for _ in range(300)]
    pairs = DECODED + [(t.encode(), t) for t in valid]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(pairs)], "i int, b binary")
    got = {r["i"]: r["t"] for r in df.select("i", F.when(~is_binary(F.col("b")), decode_text(F.col("b")))
                                                .alias("t")).collect()}
    for i, (b, t) in enumerate(pairs):
        assert got[i] == t, b


def test_scan_file(spark, tree):
    root, _ = tree
    df = scan_file(spark, str(root / "a.py"))
    assert [(r["project"], r["relative"], r["text"]) for r in df.collect()] == [("myproj", "a.py", "print('hi')\n")]
    for name, why in (("x.bin", "not a reviewable name"), ("nul.txt", "binary"), ("gone.py", "not read")):
        with pytest.raises(ValueError, match=why):
            scan_file(spark, str(root / name))


def test_paths_are_read_in_place(spark, tree):
    root, _ = tree
    names = ["a.py", "pkg/__init__.py", "x.bin", "gone.py", "Dockerfile", "nul.txt"]
    rows = read_paths(spark.createDataFrame([(f"file:{root}/{n}",) for n in names], "path string")).collect()
    got = {r["relative"]: (r["project"], r["text"], (r["error"] or "")[:8]) for r in rows}
    assert got == {"a.py": ("myproj", "print('hi')\n", ""), "__init__.py": ("pkg", "", ""), "Dockerfile": ("myproj", "FROM scratch\n", ""),
                   "x.bin": ("myproj", None, "not a re"), "gone.py": ("myproj", None, "not read")}


class OtherStore:
    """A store that no path of this machine reaches by its name, and that
    refuses some files."""

    def __init__(self, base, refused=()):
        self.base, self.refused = str(base), refused

    def __call__(self, uri):
        from pyarrow import fs

        base, refused = self.base, self.refused

        class Refusing(fs.FSSpecHandler):
            def __init__(self):
                pass

            inner = fs.SubTreeFileSystem(base, fs.LocalFileSystem())

            def get_type_name(self):
                return "other"

            def get_file_info(self, paths):
                return self.inner.get_file_info(paths)

            def get_file_info_selector(self, selector):
                if selector.base_dir.split("/")[-1] in refused:
                    raise PermissionError(f"no rights: {selector.base_dir}")
                return self.inner.get_file_info(selector)

            def open_input_stream(self, path):
                if path.split("/")[-1] in refused:
                    raise PermissionError(f"no rights: {path}")
                return self.inner.open_input_stream(path)

            def create_dir(self, path, recursive):
                self.inner.create_dir(path, recursive=recursive)

            def open_output_stream(self, path, metadata):
                return self.inner.open_output_stream(path)

        return fs.PyFileSystem(Refusing()), uri.split("://")[1]


def test_other_file_systems_and_refused_files(spark, tree, tmp_path):
    root, _ = tree
    store = OtherStore(root.parent)
    cols = ["relative", "size", "lines", "tokens", "text", "error"]
    want = sorted((tuple(r) for r in scan_corpus(spark, str(root)).select(*cols).collect()), key=str)
    assert sorted((tuple(r) for r in scan_corpus(spark, "other://myproj", store).select(*cols).collect()), key=str) == want
    part = scan_corpus(spark, ["other://myproj", "other://nowhere"], OtherStore(root.parent, ("a.py", "pkg")))
    errors = {(r["project"], r["relative"]): r["error"] for r in part.where("error is not null").collect()}
    assert set(errors) == {("myproj", "a.py"), ("myproj", "pkg"), ("nowhere", ".")}
    assert "no rights" in errors["myproj", "a.py"] and errors["myproj", "pkg"].startswith("not listed")
    assert {r["relative"] for r in readable(part).collect()} == {w[0] for w in want} - {"a.py", "pkg/__init__.py", "pkg/_part.scss"}
    assert part.where("error is not null and (text is not null or lines is not null or tokens is not null)").isEmpty()
    # write_tree goes the same way
    write_tree(spark.createDataFrame([("p", "a/b.txt", "hé"), ("p", "c.py", None)], "project string, relative string, text string"),
               "other://out", OtherStore(tmp_path))
    assert (tmp_path / "out/p/a/b.txt").read_text() == "hé" and (tmp_path / "out/p/c.py").read_text() == ""


def test_broken_and_looping_links(spark, tmp_path):
    root = tmp_path / "p"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "x.py").write_text("x")
    os.symlink(root / "nothing", root / "gone.py")
    os.symlink(root, root / "sub" / "up")
    os.symlink(root / "sub" / "x.py", root / "same.py")
    rows = {r["relative"]: r["error"] for r in scan_corpus(spark, str(root)).collect()}
    assert set(rows) == {"sub/x.py", "gone.py", "same.py"} and rows["gone.py"] and not rows["same.py"]


def test_listing_spreads_over_rounds(spark, tmp_path):
    for i in range(6):
        for j in range(5):
            p = tmp_path / "big" / f"d{i}" / f"e{j}"
            p.mkdir(parents=True)
            for k in range(3):
                (p / f"f{k}.txt").write_text(f"{i}{j}{k}")
    want = sorted(tuple(r) for r in scan_corpus(spark, str(tmp_path / "big")).select("relative", "text").collect())
    assert len(want) == 90
    for budget in (1, 4):      # every task hands most directories on
        got = scan_corpus(spark, str(tmp_path / "big"), budget=budget, partition_bytes=10)
        assert sorted(tuple(r) for r in got.select("relative", "text").collect()) == want


def test_writers_round_trip(spark, sf, tmp_path):
    from revlens.plans.review_plan import offline_review
    from revlens.sources.io import read_replies, write_reports, write_review

    r = offline_review(spark, sf)
    write_review(r.reviews.drop("usage"), r.ranked.drop("usage"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "reviews"))
    assert back.count() == r.reviews.count()
    names = [x["report"] for x in write_reports(r.report(), r.reviews, str(tmp_path / "html"), num_partitions=5).collect()]
    assert sorted(os.listdir(tmp_path / "html")) == sorted(names) and len(names) == r.reviews.count()
    lines = {}
    for x in sorted(r.report().collect(), key=lambda x: (x["project"], x["section"], x["seq"])):
        lines.setdefault(x["project"], []).append(x["html"])
    for project, want in lines.items():
        name, = [n for n in names if n.startswith(f"{project}-")]
        assert (tmp_path / "html" / name).read_text() == "\n".join(want)

    rep = r.replies.select("project", "chunk_id", "signature", F.lit(1).alias("attempt"), "raw",
                           F.create_map(F.lit("prompt_tokens"), F.col("tokens").cast("double")).alias("usage"))
    rep.write.mode("overwrite").json(str(tmp_path / "replies"))
    assert read_replies(spark, str(tmp_path / "replies")).count() == rep.count()


def test_review_of_scanned_tree(spark, tree):
    from revlens.plans.review_plan import review_corpus

    root, _ = tree
    r = review_corpus(scan_corpus(spark, str(root)), 3100, "groq", "m", 131072)
    rows = r.reviews.collect()
    assert [x["project"] for x in rows] == ["myproj"]
    assert rows[0]["chunks"] == rows[0]["initial_chunks"] >= 1
