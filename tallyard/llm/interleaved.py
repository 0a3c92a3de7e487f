"""Interleaved document sequences: ordered text and media of HTML documents.

``parse_sequences`` reads HTML into items in page order: text blocks, and references to
media by the digest of their payload, each with its caption (figcaption, else alt).
``resolve`` joins the references to a media table by digest; positions and captions stay
with their items. ``encode`` and ``decode`` store byte strings as 8-bit grey PNG images
of 192 samples a row and read them back.

Defined results: null or empty html has no items; a reference without its payload in the
media table keeps position and caption with null media; documents that share a payload
share one media row; repeated documents are parsed each; an empty table gives an empty
result. Other columns of the input stay, but for the html; those named as an added one
(``items``, then the fields of an item) are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyard.llm.common import extended, lookup_join, quoted, slices, text_of
from tallyard.llm.htmltree import BLOCK, Node, parse, walk

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# --- media ------------------------------------------------------------------


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are the payload; its length must be a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)  # filter byte 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """Samples (rows, width) of an image that ``encode`` made; checks every chunk."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, width, height, data = len(SIGNATURE), 0, 0, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean and spread of the samples and a 64-bit average hash of an 8 x 8 grid, as text."""
    flat = np.ascontiguousarray(samples).reshape(-1).astype(np.int64)
    n = len(flat)
    edges = np.arange(64) * n // 64
    sums = np.add.reduceat(flat, edges)
    # cells may differ by one sample: compared as sum * n against mean * cell size
    sizes = np.diff(np.append(edges, n))
    total = int(flat.sum())
    bits = sums * n > total * sizes
    spread = int((flat * flat).sum()) * n - total * total
    return f"{total / n:.4f}:{(max(spread, 0) ** 0.5) / n:.4f}:{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def padded(text: Column, width: int = WIDTH) -> Column:
    """UTF-8 bytes of a text and spaces up to a positive multiple of ``width``."""
    n = F.octet_length(text)
    pad = F.greatest(F.ceil(n / width) * width, F.lit(width)) - n
    return F.concat(text, F.repeat(F.lit(" "), pad.cast("int"))).cast("binary")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[str] = set()  # digests that this task has stored
    for batch in slices(batches):
        keys, media = [], []
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key not in done:
                done.add(key)
                keys.append(key)
                media.append(encode(payload.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


def store(payloads: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The media table (digest, media): one row per distinct payload of ``payloads`` (payload binary), or of those whose digest is ``wanted``."""
    keyed = payloads.select(F.sha2("payload", 256).alias("digest"), "payload")
    if wanted is not None:
        keyed = keyed.filter(wanted)
    return keyed.mapInArrow(_store, "digest string, media binary").dropDuplicates(["digest"])


# --- sequences --------------------------------------------------------------

ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
ITEM_DDL = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def items(html: str | None) -> list[dict]:
    """Text blocks and media references in page order; a figure's caption goes to its media."""
    out: list[dict] = []
    part: list[str] = []
    figures: list[dict] = []  # open figures: first item of theirs, caption so far

    def squeeze(parts: list[str]) -> str:
        return " ".join(unescape("".join(parts)).split())

    def flush() -> None:
        if text := squeeze(part):
            out.append({"kind": "text", "text": text, "digest": None, "caption": None})
        part.clear()

    skip = lambda x: x.tag in ("script", "style", "head", "template")
    caption: list[str] | None = None
    captioned: list[tuple[int, int, str]] = []  # items from, to, and the caption of each figure that has one
    for event, item in walk(parse(html or ""), skip):
        if event == "text":
            (part if caption is None else caption).append(item)
            continue
        node: Node = item
        if node.tag in BLOCK and caption is None:
            flush()
        if node.tag == "br":
            (part if caption is None else caption).append(" ")
        if event == "open" and node.tag == "img" and (digest := node.get("data-digest")):
            flush()
            out.append({"kind": "media", "text": None, "digest": digest, "caption": node.get("alt") or None})
        if node.tag == "figure":
            if event == "open":
                figures.append({"at": len(out), "caption": None})
            elif figures and (own := figures.pop())["caption"]:
                captioned.append((own["at"], len(out), own["caption"]))
        if node.tag == "figcaption" and figures:
            if event == "open":
                caption = []
            elif caption is not None:
                figures[-1]["caption"] = squeeze(caption) or None
                caption = None
    flush()
    told = 0  # of figures in figures, the outer one's caption holds
    for first, end, text in sorted(captioned, key=lambda x: (x[0], -x[1])):
        for x in out[max(first, told) : end]:
            if x["kind"] == "media":
                x["caption"] = text
        told = max(told, end)
    return [{"position": i, **x} for i, x in enumerate(out)]


def parse_sequences(docs: DataFrame, html: str = "html") -> DataFrame:
    """The columns of ``docs`` but ``html``, and ``items``: the ordered sequence."""
    kept = [c for c in docs.columns if c.lower() not in (html.lower(), "items")]
    return extended(docs, kept, F.col(html).cast("string"), {"items": ITEM_DDL}, lambda own: [pa.array([items(x.as_py()) for x in own], pa.list_(ITEM))])


def resolve(sequences: DataFrame, media: DataFrame | Callable[[Column], DataFrame], key: list[str]) -> DataFrame:
    """One row per item with its media: the columns of ``sequences``, the item's fields and ``media``.

    ``sequences`` should be materialised; ``media`` has one row per digest, or is a function
    that gives the rows of a condition on the digest.
    """
    fields = [f.name for f in ITEM]
    kept = [F.col(quoted(c)) for c in sequences.columns if c.lower() not in ("items", "media", *fields)]
    flat = sequences.select(*kept, F.inline("items"))
    texts = flat.filter("kind = 'text'").withColumn("media", F.lit(None).cast("binary"))
    found = lookup_join(flat.filter("kind = 'media'"), media, "digest", [*key, "position"], "left")
    return texts.unionByName(found)


def assemble(resolved: DataFrame, key: list[str]) -> DataFrame:
    """Items of each document back in an ordered array."""
    fields = ["position", "kind", "text", "digest", "caption", "media"]
    return resolved.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))


#: Of each media item: its row, what its document says, and what its stored bytes hold.
READ = (
    "row long, doc_id long, n_bytes long, n_texts long, n_media long, position int, caption string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for value in batch.column(7):
            media = value.as_py()
            samples = decode(media)
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(7)), *columns], [x.split()[0] for x in READ.split(", ")])


def payloads(docs: DataFrame) -> DataFrame:
    """The payload of each text, and that of its first ``WIDTH`` bytes, which is shown ahead of it."""
    whole = docs.select(padded(text_of()).alias("payload"))
    return whole.select(F.explode(F.array("payload", _start("payload"))).alias("payload"))


def _start(payload: str) -> Column:
    return F.substring(F.col(payload), 1, WIDTH)


def text_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (its digest) and html of each text.

    The lines of the text are paragraphs. After the first stands a figure that refers to the
    payload of the whole text, at the end one that refers to that of its start.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), padded(text_of()).alias("whole"))
    plain = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    size = F.octet_length("text").cast("string")
    figure = lambda digest, what: F.concat(
        F.lit('<figure><img data-digest="'), digest, F.lit(f'" alt="{what}"><figcaption>{what} of '), size, F.lit(" bytes</figcaption></figure>")
    )
    lines = F.split(plain, "\n")
    html = F.concat(
        F.lit("<article><p>"), lines[0], F.lit("</p>"), figure(F.sha2("whole", 256), "text"),
        F.lit("<p>"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "</p><p>"), F.lit("</p>"),
        figure(F.sha2(_start("whole"), 256), "start"), F.lit("</article>"),
    )
    return own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), html.alias("html"))


def media_of(sequences: DataFrame) -> DataFrame:
    """``sequences`` with a number for each row, counts of their items, and items reduced to media."""
    of = lambda kind: F.filter("items", lambda x: x["kind"] == kind)
    kept = [c for c in sequences.columns if c not in ("items", "row")]
    counts = [F.size(of(kind)).cast("long").alias(name) for kind, name in (("text", "n_texts"), ("media", "n_media"))]
    return sequences.select(F.monotonically_increasing_id().alias("row"), *kept, *counts, of("media").alias("items"))


def features(resolved: DataFrame) -> DataFrame:
    """What the stored bytes of each row's media hold: all of the item captioned as its text, place and digest of the one captioned as its start."""
    names = [x.split()[0] for x in READ.split(", ")]
    found = resolved.filter("media is not null").select(*names[:7], "media").mapInArrow(_read, READ)
    item = lambda what, fields: F.max(F.when(F.col("caption").startswith(f"{what} of "), F.struct(*fields)))
    both = found.groupBy("row").agg(item("text", names[1:]).alias("text"), item("start", ("position", "payload_bytes", "media_sha256")).alias("start"))
    return both.select("text.*", F.col("start.position").alias("start_position"), F.col("start.payload_bytes").alias("start_bytes"), F.col("start.media_sha256").alias("start_media_sha256"))
