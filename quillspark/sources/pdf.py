"""PDF files as rows: one a file, with its pages and each page's text items.

Spark lists, reads and spreads the files (``binaryFile``); ``pages_of`` is the small helper that a task
calls for one file. It reads plain and compressed objects, object streams, the page tree, and the operators
that show text, with ToUnicode maps where fonts have them. Encrypted or unreadable files yield ``error`` and no pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import with_package

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]<>()%]*|[^\s/\[\]<>()%]+|\(|\)", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Unreadable(ValueError):
    """Not a PDF, or one that can't be read."""


class Ref(int):
    """The number of an indirect object."""


class Name(str):
    pass


class Operator(str):
    pass


def _string(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return ESCAPES.get(x, b"" if x in (b"\n", b"\r", b"\r\n") else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def _tokens(data: bytes) -> Iterator[object]:
    at = 0
    while m := TOKEN.search(data, at):
        t, at = m[0], m.end()
        if t == b"(":  # nested brackets: count them
            depth, k = 1, at
            while depth and k < len(data):
                depth += {40: 1, 41: -1}.get(data[k], 0)
                k += 2 if data[k] == 92 else 1
            t, at = data[m.start() : k], k
        if t.startswith(b"%"):
            continue
        if t.startswith(b"("):
            yield _string(t[1:-1])
        elif t.startswith(b"<") and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t.startswith(b"/"):
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[+-]?\d+", t):
            yield int(t)
        elif re.fullmatch(rb"[+-]?\d*\.\d*", t) and t not in (b".", b"-", b"+"):
            yield float(t)
        else:
            yield Operator(t.decode("latin-1"))


def _values(data: bytes) -> list[object]:
    """Objects one after another, containers built and references resolved to Ref."""
    stack: list[list[object]] = [[]]
    for t in _tokens(data):
        if t in ("<<", "[") and isinstance(t, Operator):
            stack.append([])
        elif t in (">>", "]") and isinstance(t, Operator) and len(stack) > 1:
            items = stack.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2])) if t == ">>" else items)
        elif t == "R" and isinstance(t, Operator) and len(stack[-1]) > 1:
            del stack[-1][-1]
            stack[-1][-1] = Ref(stack[-1][-1])
        else:
            stack[-1].append(t)
    return stack[0]


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("not a PDF")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        trailers = []
        for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            head, sep, rest = m[2].partition(b"stream")
            number, found = int(m[1]), _values(head)
            self.objects[number] = found[0] if found else None
            if sep and isinstance(found[0], dict):
                self.streams[number] = re.sub(rb"^\r?\n", b"", rest, count=1).rpartition(b"endstream")[0]
                if found[0].get("Type") == "XRef":
                    trailers.append(found[0])
        for m in re.finditer(rb"\btrailer\b(.*?)\bstartxref", data, re.S):
            trailers += [x for x in _values(m[1]) if isinstance(x, dict)]
        if any("Encrypt" in t for t in trailers):
            raise Unreadable("encrypted")
        for number in list(self.streams):
            head = self.objects[number]
            if head.get("Type") == "ObjStm":
                inner, first = self.stream(number), int(self.get(head["First"]))
                index = [x for x in _values(inner[:first]) if isinstance(x, int)]
                ends = [*index[3::2], len(inner) - first]
                for n, a, b in zip(index[::2], index[1::2], ends):
                    self.objects.setdefault(n, next(iter(_values(inner[first + a : first + b])), None))
        roots = [t["Root"] for t in trailers if "Root" in t]
        root = self.get(roots[-1]) if roots else next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(root, dict) or "Pages" not in root:
            raise Unreadable("no page tree")
        self.root = root

    def get(self, x: object) -> object:
        return self.objects.get(x) if isinstance(x, Ref) else x

    def stream(self, number: int) -> bytes:
        data, filters = self.streams.get(number, b""), self.get(self.objects[number].get("Filter", []))
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise Unreadable(f"filter {f}")
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """(page, resources) in order; resources are inherited."""
        todo, seen = [(self.root["Pages"], {})], set()
        while todo:
            ref, resources = todo.pop()
            if ref in seen:
                raise Unreadable("page tree has a loop")
            seen.add(ref)
            node = self.get(ref) or {}
            resources = self.get(node.get("Resources", resources)) or {}
            if "Kids" in node:
                todo += [(k, resources) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                yield node, resources

    def unicode_map(self, font: dict) -> tuple[int, dict[int, str]]:
        """Bytes a code, and the text of each code, from a ToUnicode map."""
        ref, found, width = font.get("ToUnicode"), {}, 2 if font.get("Subtype") == "Type0" else 1
        if not isinstance(ref, Ref):
            return width, found
        held: list[object] = []
        for v in _values(self.stream(ref)):
            if v == "endbfchar":
                for a, b in zip(held[::2], held[1::2]):
                    found[int.from_bytes(a, "big")] = _named(b) if isinstance(b, str) else b.decode("utf-16-be", "replace")
            elif v == "endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                    for k, code in enumerate(range(int.from_bytes(a, "big"), int.from_bytes(b, "big") + 1)):
                        text = c[k] if isinstance(c, list) else (int.from_bytes(c, "big") + k).to_bytes(len(c), "big")
                        found[code] = text.decode("utf-16-be", "replace")
            elif isinstance(v, Operator):
                held = []
            else:
                held.append(v)
                continue
            held = []
        return width, found

    def items(self, page: dict, resources: dict) -> list[str]:
        """The text that each showing operator of a page shows."""
        contents = page.get("Contents", [])
        refs = contents if isinstance(contents, list) else self.get(contents) if isinstance(self.get(contents), list) else [contents]
        return self.shown(b"\n".join(self.stream(r) for r in refs if isinstance(r, Ref)), resources, ())

    def shown(self, data: bytes, resources: dict, inside: tuple) -> list[str]:
        """The same of a content stream, and of the forms that it draws. inside: the forms around it."""
        forms = self.get(resources.get("XObject", {})) or {}
        data = re.sub(rb"\bBI\s.*?\sID\s.*?\sEI\b", b" ", data, flags=re.S)  # images
        fonts = {k: self.unicode_map(self.get(v) or {}) for k, v in (self.get(resources.get("Font", {})) or {}).items()}
        width, codes, held, out = 1, {}, [], []

        def text(raw: bytes) -> str:
            if not codes:
                return raw.decode("cp1252", "replace")
            return "".join(codes.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))

        for v in _values(data):
            if not isinstance(v, Operator):
                held.append(v)
                continue
            if v == "Do" and held and isinstance(ref := forms.get(held[-1]), Ref):
                form = self.get(ref) or {}
                if form.get("Subtype") == "Form":
                    if ref in inside:
                        raise Unreadable("form draws itself")
                    out += self.shown(self.stream(ref), self.get(form.get("Resources", resources)) or {}, (*inside, ref))
            elif v == "Tf" and held:
                width, codes = fonts.get(held[-2] if len(held) > 1 else "", (1, {}))
            elif v in ("Tj", "'", '"') and held and isinstance(held[-1], bytes):
                out.append(text(held[-1]))
            elif v == "TJ" and held and isinstance(held[-1], list):
                out.append("".join(text(x) if isinstance(x, bytes) else " " * (isinstance(x, (int, float)) and x < -200) for x in held[-1]))
            held = []
        return out


def _named(glyph: str) -> str:
    """The character of a glyph's name: uniXXXX, uXXXX to uXXXXXX, space, or itself; otherwise the replacement character."""
    code = re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", glyph)
    if code:
        return chr(int(code[1] or code[2], 16))
    return " " if glyph == "space" else glyph if len(glyph) == 1 else "\ufffd"


def pages_of(content: bytes) -> list[list[str]]:
    pdf = Pdf(content)
    return [pdf.items(*p) for p in pdf.pages()]


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, name and content of each file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def parsed(found: DataFrame) -> DataFrame:
    """path, name, pages (array of arrays of items), error of files (path, name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    pages.append(pages_of(content or b""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  an odd file is an error of its own
                    pages.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("name"), pa.array(pages, pa.list_(pa.list_(pa.string()))), pa.array(errors, pa.string())], ["path", "name", "pages", "error"])

    with_package(found.sparkSession)
    return found.select("path", "name", "content").mapInArrow(run, "path string, name string, pages array<array<string>>, error string")
