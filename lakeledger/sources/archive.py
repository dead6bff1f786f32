"""The reference catalog: tar archives of YAML documents as a data source, split over tasks.

An archive is first read once by one task for each file, which writes an index: where a part of about
``PART_BYTES`` of documents begins, as a place in the stored bytes from which unpacking can start and the
bytes to pass over behind it.  The reader makes a partition of each part that holds a wanted kind.  Plain tars start
anywhere, gzip tars where a gzip member starts (``write_archives`` begins one every few documents; a tar that is a single
member is unpacked from its start by each task, which costs far less than reading its YAML).  Nothing holds an archive
whole: files are read one by one.

Most files of a catalog differ in numbers alone.  ``shape`` reads a text once for all that are alike but for their
digits, and ``flat_documents`` puts the digits in; where digits can say more than a number, a text is read for itself.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
import tarfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from operator import itemgetter

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import color

try:
    import yaml
except ImportError:  # then documents are read by ``flat_yaml``, which knows no anchors
    yaml = None

KINDS = {"brands": "brand", "materials": "material", "material-packages": "package", "material-containers": "container"}
SCHEMA = "kind string, folder string, file string, doc int, fields map<string,string>"
INDEX_SCHEMA = "path string, start long, skip long, n int, kinds array<string>"
PART_BYTES = 4 << 20
ARROW = pa.schema([("kind", pa.string()), ("folder", pa.string()), ("file", pa.string()), ("doc", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])
BATCH_ROWS = 2000
MOST_TASKS = 5000  # that read archives for an index
CUT_BYTES = 16 << 20  # of a member that is held whole
PACKED_BYTES = 1 << 16  # that share a gzip member, at most, but for one document
SHAPES = 4096  # that a task keeps
SHAPE_BYTES = 4000  # of a text that has one

ENTRY = re.compile(r"""^(?:'([^']+)'|"([^"]+)"|([A-Za-z_][\w-]*))\s*:(?:\s+(.*))?$""")


def flat_yaml(text: str) -> dict[str, str] | None:
    """Scalars of a document under dotted keys, lists of scalars comma-joined, maps in lists by their place; None for what is not one."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() not in ("---", "...")]
    found: dict[str, str] = {}
    try:
        return found if not lines or _read(lines, 0, lines[0][0], "", found) == len(lines) else None
    except ValueError:
        return None


def _read(lines: list[tuple[int, str]], i: int, indent: int, path: str, found: dict[str, str]) -> int:
    """Reads the map or list at ``indent`` from line ``i`` on; the first line after it."""
    listed: list[str] = []
    n = 0
    in_list = lines[i][1] == "-" or lines[i][1].startswith("- ")
    while i < len(lines) and lines[i][0] == indent and (lines[i][1] == "-" or lines[i][1].startswith("- ")) == in_list:
        text = lines[i][1]
        if in_list:
            body = text[1:].lstrip()
            if not body:
                if i + 1 < len(lines) and lines[i + 1][0] > indent:
                    i = _read(lines, i + 1, lines[i + 1][0], f"{path}.{n}", found)
                else:
                    i += 1
            elif ENTRY.match(body):
                lines[i] = (indent + len(text) - len(body), body)
                i = _read(lines, i, lines[i][0], f"{path}.{n}", found)
            else:
                here: dict[str, str] = {}
                _value(body, "", here)
                listed += [here[""]] if "" in here else []
                found.update({f"{path}.{n}{k}": v for k, v in here.items() if k})
                i += 1
            n += 1
            continue
        entry = ENTRY.match(text)
        if not entry:
            raise ValueError(text)
        key, value = f"{path}.{entry[1] or entry[2] or entry[3]}".lstrip("."), _plain(entry[4] or "")
        i += 1
        deeper = i < len(lines) and lines[i][0] > indent
        if not value and i < len(lines) and (deeper or (lines[i][0] == indent and lines[i][1].startswith("-"))):
            i = _read(lines, i, lines[i][0], key, found)
            continue
        more = []
        while i < len(lines) and lines[i][0] > indent:  # the rest of a text over several lines
            more.append(lines[i][1])
            i += 1
        if re.match(r"^[|>][+-]?\d?$", value):
            found[key] = ("\n" if value[0] == "|" else " ").join(more)
        else:
            _value(" ".join([value, *more]), key, found)
    if in_list and (listed or not n):
        found[path] = ",".join(listed)
    if i < len(lines) and lines[i][0] > indent:
        raise ValueError(lines[i][1])
    return i


def _plain(value: str) -> str:
    """Without a comment behind it."""
    quoted = re.match(r"""^('(?:[^']|'')*'|"(?:[^"\\]|\\.)*")\s*(#.*)?$""", value)
    return quoted[1] if quoted else re.sub(r"(^|\s)#.*$", "", value).strip()


def _value(value: str, key: str, found: dict[str, str]) -> None:
    """A scalar, or a list or map in brackets."""
    value = value.strip()
    if value[:1] in ("[", "{"):
        if value[-1:] != {"[": "]", "{": "}"}[value[0]]:
            raise ValueError(value)
        parts = [x.strip() for x in re.findall(r"""(?:'[^']*'|"[^"]*"|\[[^\]]*\]|\{[^}]*\}|[^,])+""", value[1:-1]) if x.strip()]
        listed = []
        for n, part in enumerate(parts):
            entry = ENTRY.match(part) if value[0] == "{" else None
            if value[0] == "{" and not entry:
                raise ValueError(part)
            if entry:
                _value(entry[4] or "", f"{key}.{entry[1] or entry[2] or entry[3]}", found)
            elif part[0] in "[{":
                _value(part, f"{key}.{n}", found)
            else:
                listed.append(part.strip("'\""))
        if value[0] == "[" and (listed or not parts):
            found[key] = ",".join(listed)
    elif value[:1] == "'" and value[-1:] == "'" and len(value) > 1:
        found[key] = value[1:-1].replace("''", "'")
    elif value[:1] == '"' and value[-1:] == '"' and len(value) > 1:
        found[key] = value[1:-1].replace('\\"', '"')
    elif value not in ("", "~", "null"):
        found[key] = value


def flat_node(node, path: str, found: dict[str, str]) -> None:
    """Puts what a YAML node holds under dotted keys; aliases are the nodes that they stand for, ``<<`` merges maps."""
    if isinstance(node, yaml.MappingNode):
        merged = [v for k, v in node.value if k.value == "<<"]
        own = {k.value for k, _ in node.value}
        for base in (m for v in merged for m in (v.value if isinstance(v, yaml.SequenceNode) else [v])):
            taken = {}
            flat_node(base, path, taken)
            head = f"{path}." if path else ""
            found.update({k: v for k, v in taken.items() if k not in found and k[len(head) :].split(".")[0] not in own})
        for key, value in node.value:
            if key.value != "<<":
                flat_node(value, f"{path}.{key.value}" if path else key.value, found)
    elif isinstance(node, yaml.SequenceNode):
        listed = []
        for n, item in enumerate(node.value):
            if isinstance(item, yaml.ScalarNode):
                listed += [item.value] if item.tag != "tag:yaml.org,2002:null" else []
            else:
                flat_node(item, f"{path}.{n}", found)
        if listed or not node.value:
            found[path] = ",".join(listed)
    elif node.tag != "tag:yaml.org,2002:null":
        found[path] = node.value


if yaml is not None:

    class NullLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Tells plain scalars that are null from others, and no more: ``flat_node`` asks for nothing else, and every kind is a pattern to try."""

        yaml_implicit_resolvers = {c: [r for r in rules if r[0] == "tag:yaml.org,2002:null"] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def flat_document(node) -> dict[str, str]:
    found: dict[str, str] = {}
    if isinstance(node, yaml.MappingNode):
        flat_node(node, "", found)
    return found


def yaml_documents(text: str) -> list[dict[str, str]]:
    """Every document of a file, its scalars under dotted keys; what is no map, or cannot be read, gives an empty one."""
    if yaml is None:
        return [flat_yaml(part) or {} for part in re.split(r"(?m)^---.*$", text) if part.strip()]
    out: list[dict[str, str]] = []
    try:
        for node in yaml.compose_all(text, Loader=NullLoader):
            out.append(flat_document(node))
    except (yaml.YAMLError, RecursionError):
        return [*out, {}]
    return out


DIGITS = re.compile(r"([0-9]+)")
MORE = re.compile(rb"00+")
ZEROS = bytes.maketrans(b"123456789", b"0" * 9)
RUNS = bytes(b if b in b"0123456789" else 32 for b in range(256))
#: Escapes, tags, directives, anchors with digits, block texts that give their indent: there digits are no mere text. A percent sign has a use below.
SPECIAL = re.compile(r"[\\!%\0]|[&*][^\s,\[\]{}]*[0-9]|[|>][+-]?[0-9]")
FIRST = 1_000_000_000  # digits that stand for those of a text, by their place in it


@dataclass
class Shape:
    """What all texts hold that are alike but for their digits."""

    docs: list[int]  # places of the documents that hold something
    sizes: list[int]  # and how many fields each has
    keys: list[str]
    values: str  # of all fields, a zero byte between two
    runs: Callable  # the text's runs of digits that ``values`` asks for
    wanted: Callable  # the values of the wanted fields


def picker(places: list[int]) -> Callable:
    """What gives the items at some places."""
    return itemgetter(*places) if len(places) > 1 else lambda items: tuple(items[i] for i in places)


def key_texts(node) -> Iterator[str]:
    """The texts of all keys below a YAML node."""
    if isinstance(node, yaml.MappingNode):
        for key, value in node.value:
            yield key.value
            yield from key_texts(value)
    elif isinstance(node, yaml.SequenceNode):
        for item in node.value:
            yield from key_texts(item)


@lru_cache(maxsize=SHAPES)
def shape(data: bytes, wanted: tuple[str, ...] = ()) -> Shape | None:
    """The shape of the texts that are ``data`` with other digits for each 0, or None where digits may be more than text in a value.

    It is read with digits that tell the places apart.  No rule of YAML then depends on which digits they are: a scalar with a
    digit is no null, indents and indicators hold none, and keys with digits, which could be equal or too long, are left out.
    """
    text = data.decode("utf-8", "replace")
    if SPECIAL.search(text):
        return None
    runs = itertools.count(FIRST)
    marked = re.sub("0", lambda _: str(next(runs)), text)
    if yaml is None:
        found = yaml_documents(marked)
        keys = [re.sub(r"\b[0-9]{1,9}\b", "", k) for doc in found for k in doc]  # without places in lists
    else:
        try:
            nodes = list(yaml.compose_all(marked, Loader=NullLoader))
            found = [flat_document(node) for node in nodes]
            keys = [k for node in nodes for k in key_texts(node)]
        except (yaml.YAMLError, RecursionError):
            return None
    if any(DIGITS.search(k) for k in keys):
        return None
    docs, sizes, keys, values = flat(found)
    parts = DIGITS.split("\0".join(values))
    places = {(n, k): i for i, (n, k) in enumerate(zip((n for n, size in zip(docs, sizes, strict=True) for _ in range(size)), keys, strict=True))}
    asked = [places.get((n, k), -1) for n in docs for k in wanted]
    return Shape(docs, sizes, keys, "%s".join(parts[::2]), picker([int(x) - FIRST for x in parts[1::2]]), picker(asked))


@lru_cache(maxsize=SHAPES)
def seen(_: bytes) -> list[int]:
    """Empty when a text first comes: its shape, which costs more than one reading, is made when the next one alike comes."""
    return []


def flat(found: list[dict[str, str]]) -> tuple[list[int], list[int], list[str], list[str]]:
    """Of the documents that hold something: their places, their numbers of fields, and all keys and values."""
    kept = [(n, doc) for n, doc in enumerate(found) if doc]
    return [n for n, _ in kept], [len(doc) for _, doc in kept], [k for _, doc in kept for k in doc], [v for _, doc in kept for v in doc.values()]


def flat_documents(data: bytes, wanted: tuple[str, ...] = ()) -> tuple[list[int], list[int], list[str], list[str | None]]:
    """``flat`` of ``yaml_documents``; with ``wanted``, no sizes and keys, and for each document the values under these keys."""
    if len(data) <= SHAPE_BYTES:
        alike = MORE.sub(b"0", data.translate(ZEROS))
        times = seen(alike)
        form = shape(alike, wanted) if times else None
        if not times:
            times.append(1)
        if form is not None:
            values = (form.values % form.runs(data.translate(RUNS).decode("ascii").split())).split("\0") if form.keys else []
            return (form.docs, [], [], form.wanted([*values, None])) if wanted else (form.docs, form.sizes, form.keys, values)
    found = yaml_documents(data.decode("utf-8", "replace"))
    return ([n for n, doc in enumerate(found) if doc], [], [], [doc.get(k) for doc in found if doc for k in wanted]) if wanted else flat(found)


#: A header in the plain form: name, size, check sum; an ordinary file, and no prefix to its name.
PLAIN = re.compile(rb"(?s)(.{100})[0-7\0 ]{24}([0-7]{11})\0[0-7\0 ]{12}([0-7]{6})\0 0.{100}ustar\x0000.{64}[0-7\0 ]{16}\0.{166}")


def byte_sum(data: bytes) -> int:
    """The sum of up to 512 ASCII bytes: it stays below the modulus of Adler's check sum."""
    return (zlib.adler32(data) & 0xFFFF) - 1


BLANK = tarfile.TarInfo().tobuf()


def header(name: str, size: int) -> bytes:
    """The header of an ordinary file, as tarfile writes it."""
    if not name.isascii() or len(name) > 100 or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf()
    front = name.encode().ljust(100, b"\0") + BLANK[100:124] + b"%011o\0" % size + BLANK[136:148]
    return front + b"%06o\0 " % (byte_sum(front) + 256 + byte_sum(BLANK[156:])) + BLANK[156:]


class Unpacked(io.RawIOBase):
    """The unpacked bytes of a gzip or plain stream; notes where each gzip member begins."""

    def __init__(self, raw, packed: bool) -> None:
        self.raw, self.packed = raw, packed
        self.restarts = [(0, 0)]  # (unpacked, stored) places
        self.held, self.at, self.stored, self.stream = b"", 0, 0, None

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        out = []
        while n and (part := self.raw.read(n) if not self.packed else self._more(n)):
            out.append(part)
            self.at += len(part)
            n -= len(part) if n > 0 else 0
        return b"".join(out)

    def _more(self, n: int) -> bytes:
        """Up to ``n`` bytes of the current gzip member or of the next one; none at the end."""
        while self.held or (data := self.raw.read(1 << 16)):
            self.held = self.held or data
            if self.stream is None or self.stream.eof:
                if self.stream is not None:
                    self.restarts.append((self.at, self.stored))
                self.stream = zlib.decompressobj(31)
            n_held = len(self.held)
            part = self.stream.decompress(self.held, n if n > 0 else 1 << 20)
            self.held = self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail
            self.stored += n_held - len(self.held)
            if part:
                return part
        return b""


def opened(path: str, start: int) -> Unpacked:
    """An archive from a stored place on, in any store that Arrow reads."""
    files, name = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if path.startswith("file:") else path)
    raw = files.open_input_file(name)
    packed = raw.read_at(2, 0) == b"\x1f\x8b"
    raw.seek(start)
    return Unpacked(raw, packed)


class Behind(io.RawIOBase):
    """Bytes, and a stream behind them."""

    def __init__(self, held: bytes, stream: Unpacked) -> None:
        self.held, self.stream = io.BytesIO(held), stream

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        return self.held.read(n) or self.stream.read(n)


def members(stream: Unpacked) -> Iterator[tuple[int, str, int, Callable[[], bytes] | None]]:
    """(place, name, size, reader) of each member of a tar from the stream's place on; no reader for what is no file.

    Members with a plain header are cut from the unpacked bytes; from the first other one on, tarfile reads. A reader is to be
    called before the next member is asked for.
    """
    held, at, passed = b"", 0, 0
    while True:
        if len(held) - at < 1 << 15:
            held, at, passed = held[at:] + stream.read(1 << 17), 0, passed + at
        head = held[at : at + 512]
        plain = PLAIN.fullmatch(head) if head.isascii() else None
        if plain is None or byte_sum(head) - byte_sum(head[148:156]) + 256 != int(plain[3], 8):
            break
        size = int(plain[2], 8)
        end = at + 512 + size + -size % 512
        if end > len(held) and size <= CUT_BYTES:
            held, at, passed, end = held[at:] + stream.read(end - len(held)), 0, passed + at, end - at
        if end > len(held):
            break
        yield passed + at, plain[1].partition(b"\0")[0].decode("ascii"), size, partial(held.__getitem__, slice(at + 512, at + 512 + size))
        at = end
    # tarfile takes bad bytes at its start for no tar, and for the tar's end later on: an empty member stands for those before
    before = BLANK if passed + at else b""
    with tarfile.open(fileobj=Behind(before + held[at:], stream), mode="r|") as tar:
        for member in itertools.islice(tar, 1 if before else 0, None):
            tar.members = []  # or tarfile keeps every header
            read = partial(lambda m: tar.extractfile(m).read(), member) if member.isfile() else None
            yield passed + at + member.offset - len(before), member.name, member.size, read


def place(name: str) -> tuple[str, str, str] | None:
    """Kind, folder and file of a member that is a document, else nothing."""
    if not name.endswith((".yaml", ".yml")):
        return None
    folder, _, file = name.rpartition("/")
    at = place_of_folder(folder)
    return at and (*at, file)


@lru_cache(maxsize=SHAPES)
def place_of_folder(name: str) -> tuple[str, str] | None:
    parts = name.split("/")
    at = next((i for i, p in enumerate(parts) if p in KINDS and i > 0 and parts[i - 1] == "data"), None)
    return None if at is None else (KINDS[parts[at]], parts[at + 1] if len(parts) > at + 1 else "")


def parts_of(path: str, part_bytes: int) -> Iterator[tuple[str, int, int, int, list[str]]]:
    """(path, start, skip, members, kinds) of each part of an archive, in one streaming pass over its headers."""
    stream = opened(path, 0)
    if not stream.raw.size():
        return
    first, n, size, kinds = None, 0, 0, set()
    for offset, name, n_bytes, _ in members(stream):
        if first is None:
            first = offset
        n, size = n + 1, size + n_bytes
        if at := place(name):
            kinds.add(at[0])
        if size >= part_bytes:
            yield (path, *restart(stream, first), n, sorted(kinds))
            first, n, size, kinds = None, 0, 0, set()
    if n:
        yield (path, *restart(stream, first), n, sorted(kinds))


def restart(stream: Unpacked, at: int) -> tuple[int, int]:
    """The last stored place to unpack from for the unpacked place ``at``, and the bytes between; earlier ones are forgotten."""
    if not stream.packed:
        return at, 0
    before = [r for r in stream.restarts if r[0] <= at]
    stream.restarts = stream.restarts[len(before) - 1 :]
    return before[-1][1], at - before[-1][0]


@dataclass
class Part(InputPartition):
    """Consecutive members of one archive."""

    path: str
    start: int
    skip: int
    n: int


def wanted_fields(options: dict[str, str]) -> tuple[str, ...]:
    return tuple(k for k in options.get("fields", "").split(",") if k)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.index = options["index"]
        self.kinds = {k.strip() for k in options.get("kinds", "").split(",") if k.strip()}
        self.fields = wanted_fields(options)

    def partitions(self) -> list[Part]:
        """One for each row of the index with a wanted kind; it grows with the archives' bytes, not with their documents."""
        files, name = pa.fs.FileSystem.from_uri(self.index)
        rows = pa.dataset.dataset(name, filesystem=files, format="parquet").to_table().to_pylist()
        wanted = [Part(r["path"], r["start"], r["skip"], r["n"]) for r in rows if not self.kinds or self.kinds & set(r["kinds"])]
        return sorted(wanted, key=lambda p: (p.path, p.start, p.skip))

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        files = self.files(partition)
        rest = True
        while rest:
            rest = False
            kinds, folders, names, docs, sizes, keys, values = ([] for _ in range(7))
            for kind, folder, name, data in files:
                found = flat_documents(data, self.fields)
                n = len(found[0])
                kinds += [kind] * n
                folders += [folder] * n
                names += [name] * n
                docs += found[0]
                sizes += found[1]
                keys += found[2]
                values += found[3]
                if len(docs) >= BATCH_ROWS:
                    rest = True
                    break
            arrays = [pa.array(c, f.type) for c, f in zip((kinds, folders, names, docs), ARROW, strict=False)]
            if self.fields:
                found = pa.StructArray.from_arrays([pa.array(values[i :: len(self.fields)], pa.string()) for i in range(len(self.fields))], names=self.fields)
            else:
                starts = pa.array(list(itertools.accumulate(sizes, initial=0)), pa.int32())
                found = pa.MapArray.from_arrays(starts, pa.array(keys, pa.string()), pa.array(values, pa.string()))
            yield pa.RecordBatch.from_arrays([*arrays, found], names=ARROW.names)

    def files(self, partition: Part | None) -> Iterator[tuple[str, str, str, bytes]]:
        """Kind, folder, name and bytes of each file of documents; Spark asks for no part where there is none."""
        if partition is None:
            return
        stream = opened(partition.path, partition.start)
        stream.read(partition.skip)
        for k, (_, name, _, read) in enumerate(members(stream)):
            if k == partition.n:
                return
            at = place(name) if read else None
            if at is not None and (not self.kinds or at[0] in self.kinds):
                yield (*at, read())


class ReferenceArchives(DataSource):
    """``spark.read.format("reference_archive").option("index", ...)``: documents of the archives that an index names.

    ``kinds`` (a comma list) leaves out members of other kinds before their YAML is read. ``fields`` (a comma list of dotted keys) makes
    the column of that name a struct of these, where it is a map of all keys else.
    """

    @classmethod
    def name(cls) -> str:
        return "reference_archive"

    def schema(self) -> str:
        fields = wanted_fields(self.options)
        return SCHEMA.replace("map<string,string>", f"struct<{','.join(f'`{k}`:string' for k in fields)}>") if fields else SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def write_index(spark: SparkSession, path: str, index: str, part_bytes: int = PART_BYTES) -> None:
    """Writes the parts of all archives under ``path``, each archive read by a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = list(parts_of(name, part_bytes))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "start", "skip", "n", "kinds"])

    files = spark.read.format("binaryFile").load(path).select("path")
    # a path is few bytes and an archive many: with a number given, and by range, the paths are not put together again
    files.repartitionByRange(max(1, min(files.count(), MOST_TASKS)), "path").mapInArrow(run, INDEX_SCHEMA).write.parquet(index)


def documents(spark: SparkSession, path: str, index: str, part_bytes: int = PART_BYTES, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(kind, folder, file, doc, fields) of every document in the archives under ``path``; bad ones are skipped.

    ``index`` is a new folder where all tasks see it.
    """
    write_index(spark, path, index, part_bytes)
    return indexed(spark, index, kinds)


def indexed(spark: SparkSession, index: str, kinds: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` of an index that is there; only parts with one of ``kinds`` are opened, and only ``fields`` kept, if any are given.

    Each use of the rows reads them again.
    """
    spark.dataSource.register(ReferenceArchives)
    return spark.read.format("reference_archive").option("index", index).option("kinds", ",".join(kinds)).option("fields", ",".join(fields)).load()


def write_archives(members: DataFrame, path: str, per_file: int = 20_000, packed: int = 1) -> None:
    """Writes (name, body) rows as gzip tars of up to ``per_file`` members, a gzip member for up to ``packed`` of them.

    Spark's text writer writes them: a gzip member ends in the highest byte of its length, which is zero below
    16 MB, and a zero is what the writer puts after each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, size = [], [], 0
            rows = zip(batch.column("name").to_pylist(), batch.column("body"), strict=True)
            for n, (name, body) in enumerate(rows, 1):
                data = body.as_buffer().to_pybytes()
                held.append(header(name, len(data)) + data + b"\0" * (-len(data) % 512))
                size += len(held[-1])
                if len(held) == packed or size >= PACKED_BYTES or n == batch.num_rows:
                    whole = gzip.compress(b"".join(held), 1, mtime=0)
                    if whole[-1]:
                        whole += gzip.compress(b"", mtime=0)
                    out.append(whole[:-1])
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = members.select("name", F.col("body").cast("binary")).mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, per_file // packed)).text(path)


#: Columns of a material -> number under ``properties``.
NUMBERS = {
    "nozzle_temp_min": "min_print_temperature", "nozzle_temp_max": "max_print_temperature", "bed_temp_min": "min_bed_temperature", "bed_temp_max": "max_bed_temperature",
    "chamber_temp_min": "min_chamber_temperature", "chamber_temp_max": "max_chamber_temperature", "preheat_temp": "preheat_temperature", "drying_temp": "drying_temperature",
    "drying_time": "drying_time", "hardness_shore_d": "hardness_shore_d", "hardness_shore_a": "hardness_shore_a", "heatbreak_temp": "heatbreak_temperature",
    "nozzle_diameter_min": "min_nozzle_diameter", "cure_wavelength": "cure_wavelength",
}


#: What ``packages`` reads.
PACKAGE_FIELDS = (
    "class", "material.slug", "slug", "uuid", "gtin", "brand_specific_id", "url", "nominal_netto_full_weight", "filament_diameter", "filament_diameter_tolerance", "container.slug",
)


def _get(key: str) -> Column:
    return F.col("fields")[key]


def _number(key: str) -> Column:
    return _get(key).try_cast("double")


def _filaments(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of the filament class; an unknown class counts as filament."""
    return docs.filter(F.col("kind") == kind).filter(F.coalesce(_get("class"), F.lit("FFF")) == "FFF")


def materials(docs: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """Materials of the filament class with their brand's name, or its slug where the brand is not there; ``brands`` are documents too, if they are kept apart."""
    brands = (docs if brands is None else brands).filter("kind = 'brand'").groupBy(_get("slug").alias("brand_slug")).agg(F.max_by(_get("name"), "file").alias("_brand"))
    rows = _filaments(docs, "material").withColumn("brand_slug", F.coalesce(_get("brand.slug"), "folder"))
    place = lambda e: F.struct(F.split(e["key"], r"\.")[1].cast("int").alias("at"), color.rgba_to_hex(e["value"]).alias("hex"))
    secondary = F.array_sort(F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"].rlike(r"^secondary_colors\.\d+\.color_rgba$")), place))
    chamber = F.coalesce(F.nullif(_number("properties.min_chamber_temperature"), F.lit(0.0)), _number("properties.chamber_temperature"))
    return rows.join(brands, "brand_slug", "left").select(
        _get("uuid").alias("uuid"), _get("slug").alias("slug"), F.coalesce("_brand", "brand_slug").alias("brand"), _get("name").alias("name"), _get("type").alias("type"),
        color.rgba_to_hex(F.coalesce(_get("primary_color.color_rgba"), _get("primary_color"))).alias("color"), F.filter(F.split(F.coalesce(_get("tags"), F.lit("")), ","), lambda t: t != "").alias("tags"),
        F.coalesce(_number("properties.density"), _number("density")).alias("density"), "brand_slug", _get("abbreviation").alias("abbreviation"),
        F.filter(F.transform(secondary, lambda s: s["hex"]), lambda h: h.isNotNull()).alias("secondary"), chamber.alias("chamber_temp"), *(_number(f"properties.{k}").alias(c) for c, k in NUMBERS.items()),
        _number("transmission_distance").alias("transmission_distance"), _get("photos.0.url").alias("photo_url"), _get("url").alias("product_url"),
    )


def packages(docs: DataFrame) -> DataFrame:
    """Packages of the filament class that name a material, to be joined by its slug; ``ord`` is their order."""
    return _filaments(docs, "package").select(
        _get("material.slug").alias("material"), F.concat_ws("/", "folder", "file", F.lpad(F.col("doc").cast("string"), 6, "0")).alias("ord"), _get("slug").alias("slug"), _get("uuid").alias("uuid"), _get("gtin").alias("gtin"),
        _get("brand_specific_id").alias("brand_specific_id"), _get("url").alias("url"), _number("nominal_netto_full_weight").alias("net"), _number("filament_diameter").alias("diameter"),
        _number("filament_diameter_tolerance").alias("tolerance"), _get("container.slug").alias("container"),
    ).filter("material is not null")


def containers(docs: DataFrame) -> DataFrame:
    """Containers, one row per slug: the last document counts."""
    sizes = [_number(k).alias(k) for k in ("outer_diameter", "inner_diameter", "hole_diameter", "width")]
    row = F.struct(_get("uuid").alias("uuid"), _get("name").alias("name"), _get("class").alias("class"), _get("brand.slug").alias("brand"), _number("empty_weight").alias("tare"), *sizes)
    rows = docs.filter("kind = 'container'").filter(_get("slug").isNotNull())
    return rows.groupBy(_get("slug").alias("slug")).agg(F.max_by(row, F.concat_ws("/", "folder", "file")).alias("r")).select("slug", "r.*")
