"""Generated, minified, vendored files and data saved as code.

Every path is brought to one spelling and read once, together with the remark on
the file's head, by a multi-pattern automaton (Aho-Corasick) whose patterns are
generation notices, directories of copies and build outputs, and name endings.
Three expressions for names with versions and content hashes, and the length of
the lines, decide the rest. Dispositions are not trusted and not read.

Defined results
---------------
* null path: class ``unknown``, no case; an empty path is ``noncode``;
* sizes or remarks that are null or empty just don't speak;
* documents, images, configuration, translations, data files and lock files are
  ``noncode`` wherever they lie;
* a row delivered twice gives one case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Longest mean line, in bytes, that people write.
MAX_MEAN_LINE = 500

CASES = ("generated", "minified", "vendored", "data")

# Endings of source files.
CODE_ENDINGS = (
    "py pyi pyx js mjs cjs jsx ts tsx mts cts vue svelte java kt kts scala groovy go cs vb fs php rb c cc cpp cxx h hh hpp hxx inl m mm rs "
    "swift dart lua pl pm r jl ex exs erl hs clj elm sol sql sh bash ps1 bat asm s css scss sass less proto thrift graphql"
).split()
# Directories of copies of other projects.
VENDORED_DIRS = (
    "node_modules bower_components jspm_packages web_modules vendor vendored _vendor .vendor third_party third-party thirdparty 3rdparty "
    "3rd_party extern external externals deps site-packages dist-packages godeps pods carthage/checkouts elm-stuff .pnpm .yarn "
    "contrib/bundled subprojects/packagefiles pkg/mod bundled .bundle .cargo/registry"
).split()
# Directories that tools and builds write.
GENERATED_DIRS = (
    "generated __generated__ generated-sources generated-src generated-test-sources generated-migrations codegen-out swagger-gen autogen gen "
    "bazel-out bazel-bin bazel-genfiles cmake-build-debug cmake-build-release cmakefiles obj/debug obj/release target/classes target/generated-sources "
    "build/generated build/gen build/tmp .svelte-kit/generated __pycache__ .dart_tool"
).split() + ["service references"]
BUNDLE_DIRS = "dist .next _next .nuxt _nuxt .output .parcel-cache public/build public/packs build/static out/_next wwwroot/dist storybook-static".split()
# Parts of names that generators give.
GENERATED_PARTS = (
    ".pb. _pb2. _pb2_grpc. .generated. _generated. .gen. _gen. _autogen. .autogen. .auto. .designer. .freezed. .g.dart .g.cs .g.i.cs .tab.c .tab.h "
    ".yy.c .yy.h _wrap.c _wrap.cpp .assemblyinfo.cs .graphql.ts .graphql.js outerclass.java grpc.java grpc.cs _.java _string.go _mock.go .pb.go .twirp.go"
).split()
GENERATED_STARTS = "zz_generated moc_ qrc_ ui_ lex.".split()
GENERATED_NAMES = ["reference.cs", "assemblyinfo.cs"]
MINIFIED_PARTS = ".min. -min. _min. .pack. .packed. .ugly. .uglified. .compressed. .bundle. .chunk. -bundle.js .prod.js".split()
MINIFIED_STARTS = "vendors~ runtime~ chunk- bundle. main.chunk".split()
DATA_PARTS = (
    "_rawdata. _hexdump. _bytes. _base64. _polygons. _weights. _dataset. _embedded. _blob. _ttf. _dump. _sprite_data. .data. .xpm. .font. .inc.h _bin.h _woff."
).split()
DATA_STARTS = "bindata_ wordlist_".split()
VENDORED_PARTS = ["_amalgamation", "-amalgamation", "sqlite3.c"]
LOCK_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml composer.lock gemfile.lock cargo.lock poetry.lock go.sum pipfile.lock podfile.lock mix.lock flake.lock".split()
# What heads of files and their readers say about their origin.
NOTICES = {
    "generated": [
        "do not edit", "do not modify", "@generated", "autogenerated", "auto-generated", "automatically generated", "generated by", "generated from",
        "machine-written", "machine generated", "edits are lost", "code produced from", "template run", "written by build step", "schema compiler",
        "automatisch erzeugt", "automatisch generiert", "généré automatiquement", "generado automáticamente", "gerado automaticamente",
        "сгенерировано", "自动生成", "自動生成",
    ],
    "minified": ["source map reference", "sourcemappingurl", "transpiled", "minified", "bundled for shipping"],
    "vendored": ["verbatim copy of", "imported drop from", "identical to upstream", "foreign copyright", "copied from upstream", "vendored from"],
}

_VERSIONED_DIR = re.compile(r"/[a-z][\w.\-]*?[-@]v?\d+\.\d+(?:\.\d+)+[\w.\-]*/")
_VERSIONED_NAME = re.compile(r"/[a-z][\w.]*(?:-[a-z]\w*)*-v?\d+\.\d+\.\d+(?:[.\-](?:umd|full|slim|esm|cjs|min|prod|dev|all|core|common|global|module|standalone))*\.(?:m?js|cjs|ts|css)$")
_HASHED = re.compile(r"[.\-~](?=[a-f]*\d)[0-9a-f]{6,32}(?:\.(?:bundle|chunk|min|module))*\.(?:m?js|cjs|css)$")
_CODE = re.compile(r"\.(?:" + "|".join(CODE_ENDINGS) + r")$")


def plain_path(path: str) -> str:
    """One spelling of a path: decoded, forward slashes, lower case, no doubled or leading parts."""
    p = path.strip().replace("\\", "/")
    if "%" in p:
        p = unquote(p)
    p = re.sub(r"/(?:\./)*/*", "/", "/" + p.lower())
    return re.sub(r"^(?:/\.)+(?=/)", "", p)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All patterns with where they must stand (d directory, n in the name, s at its start, = the name, h in the remark) and what they mean."""
    a = ahocorasick.Automaton()
    meant: dict[str, list] = {}

    def add(patterns: list[str], place: str, kind: str) -> None:
        for p in patterns:
            key = f"/{p}/" if place == "d" else f"/{p}" if place == "s" else f"/{p}\n" if place == "=" else p
            meant.setdefault(key, []).append((place, kind, len(key)))

    add(VENDORED_DIRS, "d", "vendored")
    add(GENERATED_DIRS, "d", "generated")
    add(BUNDLE_DIRS, "d", "minified")
    add(GENERATED_PARTS, "n", "generated")
    add(GENERATED_STARTS, "s", "generated")
    add(GENERATED_NAMES, "=", "generated")
    add(MINIFIED_PARTS, "n", "minified")
    add(MINIFIED_STARTS, "s", "minified")
    add(DATA_PARTS, "n", "data")
    add(DATA_STARTS, "s", "data")
    add(VENDORED_PARTS, "n", "vendored")
    add(LOCK_NAMES, "=", "noncode")
    for kind, notices in NOTICES.items():
        add(notices, "h", kind)
    for key, value in meant.items():
        a.add_word(key, value)
    a.make_automaton()
    return a


_ORDER = {"vendored": 0, "minified": 1, "data": 2, "generated": 3}


def origin(path: str | None, remark: str | None, n_lines: int | None, n_bytes: int | None) -> str:
    """generated, minified, vendored, data, noncode, handwritten or unknown."""
    if path is None:
        return "unknown"
    p = plain_path(path)
    if not _CODE.search(p):
        return "noncode"
    name_at = p.rfind("/")
    text = f"{p}\n{remark.lower()}" if remark else p + "\n"
    found = set()
    for end, meanings in automaton().iter(text):
        for place, kind, size in meanings:
            start = end - size + 1
            if place == "h":
                ok = start > len(p)
            elif place == "d":
                ok = end <= name_at
            elif place == "n":
                ok = name_at < start and end < len(p) + (size and text[end] == "\n")
            else:
                ok = start == name_at
            if ok:
                found.add(kind)
    if "noncode" in found:
        return "noncode"
    if found:
        return min(found, key=_ORDER.__getitem__)
    if _VERSIONED_DIR.search(p) or _VERSIONED_NAME.search(p):
        return "vendored"
    if _HASHED.search(p):
        return "minified"
    if n_lines is not None and n_bytes is not None and n_bytes > MAX_MEAN_LINE * max(n_lines, 1):
        return "minified" if n_bytes < 1_000_000 else "data"
    return "handwritten"


def with_origin(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the ``origin`` of every row; one narrow pass over path, remark and sizes."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", origin string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(keep)
            read = [b.column(i).to_pylist() for i in range(n, n + 4)]
            kind = pa.array([origin(*row) for row in zip(*read, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), kind], names=[*keep, "origin"])

    read = [F.col("path").alias("_p"), F.col("detail").alias("_d"), F.col("n_lines").cast("bigint").alias("_l"), F.col("n_bytes").cast("bigint").alias("_b")]
    return df.select(*keep, *read).mapInArrow(run, ddl)


def not_handwritten(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of files nobody wrote by hand in their project, each once."""
    return with_origin(df, keep).where(F.col("origin").isin(*CASES)).select(*keep).distinct()
