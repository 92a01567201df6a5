"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of text and media-reference structs.  A reference names its payload by the
SHA-256 digest of its bytes (``src="media:<digest>"``) and carries the caption found around it; a join on the digest
resolves it against the media table.  Order and captions are those of the page.

Media are stored as binary greymaps (P5): the payload's bytes are the samples, ``WIDTH`` to a row, padded with
blanks to whole rows, so storing loses nothing.

Defined cases: null html has no items; a reference to an unknown digest stays in the sequence, unresolved; null
text is stored as the empty text, one row of blanks; equal payloads are stored once; media that aren't whole greymaps
have null features; a head, title, figure or caption that is never closed hides no text; a caption belongs to all
media of its figure, before or behind it, and is text if there are none; a page read twice gives its sequence twice; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelwell.llm import blocks  # functions here travel by value

WIDTH = 192
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


class _Page(HTMLParser):
    """Collects [kind, text, digest, caption] in page order.  No visible text is lost on pages that leave tags open."""

    HIDDEN = frozenset({"script", "style", "template"})
    OF_HEAD = frozenset({"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"})
    BREAKS = frozenset({"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article", "ul", "ol", "table", "blockquote", "body"})
    MEDIA = frozenset({"img", "audio", "video", "source", "embed"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.hidden = 0
        self.head = self.title = False
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.figures[-1]["captions"] += [text] if text else []
            self.caption = None

    def end_figure(self) -> None:
        """Gives its caption to all media of the figure; a caption without media is text."""
        self.end_caption()
        figure = self.figures.pop()
        text = " ".join(figure["captions"])
        for i in figure["media"] if text else []:
            self.items[i][3] = text
        self.flush()
        if text and not figure["media"]:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag not in self.OF_HEAD:  # the head ends here, closed or not
            self.head = self.title = False
        if tag in ("head", "title"):
            setattr(self, tag, True)
        elif tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.BREAKS and self.caption is not None:
            self.caption.append(" ")
        elif tag in self.BREAKS:
            self.flush()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append({"media": [], "captions": []})
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in self.MEDIA and not self.hidden:
            a = dict(attrs)
            src = a.get("src") or ""
            if src:
                self.flush()
                self.items.append(["media", None, src.removeprefix("media:"), a.get("alt") or None])
                if self.figures:
                    self.figures[-1]["media"].append(len(self.items) - 1)

    def handle_endtag(self, tag):
        if tag in ("head", "title"):
            setattr(self, tag, False)
        elif tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_figure()
        elif tag in self.BREAKS and self.caption is None:
            self.flush()

    def handle_data(self, data):
        if self.hidden or self.title or (self.head and not data.strip()):
            return
        self.head = False
        (self.words if self.caption is None else self.caption).append(data)

    def finish(self) -> list[list]:
        self.close()
        if self.caption is not None:  # never closed: what follows can't be told from the caption, so all of it is text
            self.words, self.caption = self.caption, None
        self.flush()
        while self.figures:
            self.end_figure()
        return self.items


def parse_page(html: str | None) -> list[dict]:
    if html is None:
        return []
    page = _Page()
    page.feed(html)
    return [dict(zip(("position", "kind", "text", "digest", "caption"), (i, *x), strict=True)) for i, x in enumerate(page.finish())]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, items: the ordered structs of every page."""

    def run(batches):
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([parse_page(x) for x in b.column("html").to_pylist()], kind)], ["key", "items"])

    blocks.bound_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, items {ITEMS}").withColumnRenamed("key", key)


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """A page with the text's lines as paragraphs, then the media of that digest with a caption."""
    escaped = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p>\n<p>"))
    return F.concat(F.lit("<html><head><title>document</title><body><p>"), escaped, F.lit("</p><figure><img src='media:"), digest, F.lit("'><figcaption>"), caption, F.lit("</figcaption></figure>"))


def payload_of(text: Column) -> Column:
    """The text's UTF-8 bytes, padded with blanks to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)).cast("int")
    return F.rpad(raw, rows * WIDTH, F.lit(bytearray(b" ")))


def stored(payload: Column) -> Column:
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("int").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), payload)


def read_greymap(raw: bytes | None) -> np.ndarray | None:
    """Rows x columns of a P5 file with 8-bit samples and no comments; None if it isn't one, or isn't whole."""
    found = re.match(rb"P5\n(\d{1,9}) (\d{1,9})\n255\n", raw or b"")
    if not found:
        return None
    width, height = map(int, found.groups())
    if not width * height or len(raw) - found.end() != width * height:
        return None
    return np.frombuffer(raw, np.uint8, width * height, found.end()).reshape(height, width)


def feature(image: np.ndarray) -> str:
    """Size, mean, spread, mean step along rows, and eight shares of the sample range in percent."""
    x = image.astype(np.int64)
    n = x.size
    share = np.bincount(image.reshape(-1) >> 5, minlength=8) * 100 // n
    step = int(np.abs(np.diff(x, axis=1)).sum()) // max(1, image.shape[0] * (image.shape[1] - 1))
    return f"{image.shape[1]}x{image.shape[0]};mean={int(x.sum()) // n};var={(n * int((x * x).sum()) - int(x.sum()) ** 2) // (n * n)};step={step};hist={'-'.join(map(str, share))}"


def measure(media: DataFrame) -> DataFrame:
    """digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored media."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for raw in b.column("media").to_pylist():
                image = read_greymap(raw)
                held = (None, None) if raw is None else (len(raw), hashlib.sha256(raw).hexdigest())
                if image is None:
                    out.append((None, None, None, *held, None))
                    continue
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *held, feature(image)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("digest"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("digest", "media").mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_table(docs: DataFrame) -> DataFrame:
    """digest, media: one stored greymap for each distinct payload of ``docs.text``."""
    rows = docs.select(payload_of(F.col("text")).alias("payload")).select(F.sha2("payload", 256).alias("digest"), stored(F.col("payload")).alias("media"))
    return rows.dropDuplicates(["digest"])


def resolve(items: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """key, position, kind, text, caption, digest and what ``media`` has of the digest, one row for each item."""
    flat = items.select(key, F.explode("items").alias("i")).select(key, "i.*")
    return flat.join(media, "digest", "left")
