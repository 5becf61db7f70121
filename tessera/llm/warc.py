"""WARC archives of captures, and their index by an external merge.

Writing: a record per page, an HTTP response with its payload, or a revisit without one where an equal payload of some length is
kept by another record. Payloads that have no copy are written where they are read: a bitmap of the digests that repeat tells
them from all others, and only the rest, and records much longer than the mean, are dealt by digest. Records are text and go out
through Spark's own writer, whose line separator is the blank lines that end a WARC record, so archives may lie in any store that
Spark can write to. Archives hold a bounded number of records.

Reading: each archive is parsed by one task, payloads are hashed again, and its captures leave as a run sorted by URL key and
time. The runs are dealt by ranges of the whole order (URL key, time, archive, offset: so the captures of one hot URL are split,
too); a task merges its slices of all runs with a loser tree. Range after range, the result is one ordered index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir, text_or_empty

#: Payloads from this length on are kept once.
LEAST_KEPT = 1000
#: Bytes of an archive, about, and captures that a merge task has at most, about.
ARCHIVE_BYTES = 16_000_000
MERGE_ROWS = 50_000
#: Words of 64 bits of the bitmap, at most (4 MB of keys and bits), and how many times the mean a record may have that isn't dealt.
BITMAP_WORDS = 1 << 18
LONG_RECORD = 4
#: Bytes of a record besides its payload, about.
OVERHEAD = 600

# Fixed values of the format.
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "

#: Columns of a run.
RUN = "archive string, offset long, length long, url_key string, captured string, url string, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def _header(*fields: tuple[str, Column]) -> Column:
    """A WARC header: fields whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("\r\n", *lines), F.lit(END))


def _urn(key: Column) -> Column:
    return F.concat(F.lit(f"<{ID}"), F.url_encode(key.cast("string")), F.lit(">"))


def _cell() -> tuple[Column, Column]:
    """The word of the bitmap and the bit in it of column digest."""
    return F.pmod(F.xxhash64("digest"), F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(digest), 58) AS INT))")


def _marked(rows: DataFrame, repeated: DataFrame, least: int, mean: float) -> DataFrame:
    """Add dealt to rows (digest, bytes): true where the payload may have copies that revisit it, or is long for an archive's mean.

    Digests share bits, so some payloads without a copy are dealt too; none with a copy is missed.
    """
    word, bit = _cell()
    bitmap = repeated.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.withColumn("word", word).join(F.broadcast(bitmap), "word", "left").drop("word")
    known = (F.col("bytes") >= least) & (F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(bit) != 0)
    return found.withColumn("dealt", known | (F.col("bytes") + OVERHEAD > LONG_RECORD * mean)).drop("bits")


def _records(pages: DataFrame) -> DataFrame:
    """(record): the WARC record of each page (page_id, url, payload, digest, bytes, captured, kept); kept is null where no copy is kept."""
    revisits = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    block = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END), F.when(revisits, F.lit("")).otherwise(F.col("payload")))
    header = _header(
        ("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        ("WARC-Record-ID", F.coalesce(_urn(F.col("page_id")), F.lit(f"<{ID}>"))),
        ("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisits, PROFILE)),
        ("WARC-Refers-To", F.when(revisits, _urn(F.col("kept")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    return pages.withColumn("block", block).select(F.concat(header, "block").alias("record"))


def write_archives(pages: DataFrame, captured: Column, folder: str, least: int = LEAST_KEPT) -> None:
    """Write a WARC record for each row of pages (page_id, url, html) to new archives in folder.

    The payload is the html in UTF-8, null html an empty one. Of records with equal payloads of `least` bytes or more the one
    with the largest page_id is a response, and so are repeated rows of that id; the others, null ids too, revisit it. Where
    all ids are null, all are responses. captured is the time of the capture, null the epoch. Line ends in a url are
    percent-encoded; a null url has no target.
    """
    payload = text_or_empty("html")
    pages = pages.select("page_id", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.coalesce(captured.cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("captured"))
    groups = materialize(pages.groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("rows")), "warc-payloads")
    size = groups.agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * (F.col("bytes") + OVERHEAD)).alias("bytes")).first()
    mean = (size["bytes"] or 1) / (size["rows"] or 1)
    kept = groups.where((F.col("bytes") >= least) & (F.col("rows") > 1)).select("digest", "kept")
    sizes = {row["dealt"]: row for row in _marked(groups, kept, least, mean).groupBy("dealt").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * (F.col("bytes") + OVERHEAD)).alias("bytes")).collect()}
    marked = _marked(pages, kept, least, mean)
    parts = {False: marked.where("NOT dealt").withColumn("kept", F.lit(None).cast(pages.schema["page_id"].dataType)), True: marked.where("dealt").join(kept, "digest", "left")}
    for dealt, part in parts.items():
        if dealt in sizes or not dealt:
            found = sizes.get(dealt) or {"rows": 1, "bytes": 1}
            records = max(1, int(ARCHIVE_BYTES * found["rows"] // found["bytes"]))
            _records(part).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(folder)


def url_key(url: str | None) -> str:
    """The canonical key of a url: the host's labels in reverse with commas, `)`, then path and query; all lower-cased."""
    rest = (url or "").lower().partition("://")[2]
    ends = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:ends].rpartition("@")[2].partition(":")[0]
    return ",".join(reversed(host.split("."))) + ")" + (rest[ends:].partition("#")[0] or "/")


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields by lower-cased name, block) of every record of an archive."""
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        lines = content[at : max(at, stop)].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it says")
        yield at, end + 4 - at, fields, content[begin:end]
        at = end + 4


def _captures(name: str, content: bytes) -> list[tuple]:
    """The run of an archive: its captures by URL key, time and offset."""
    rows = []
    for offset, length, fields, block in parse(content):
        head, _, payload = block.partition(b"\r\n\r\n")
        kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").partition(":")[2]
        size, intact = len(payload), None
        if kind == "response":
            found = hashlib.sha1(payload).hexdigest()
            digest, intact = found, found == digest
        else:
            size = int(next(line for line in head.decode().split("\r\n") if line.startswith("Content-Length: "))[16:])
        ids = [fields[f].removeprefix(f"<{ID}").removesuffix(">") if f in fields else None for f in ("warc-record-id", "warc-refers-to")]
        url = fields.get("warc-target-uri")
        rows.append((name, offset, length, url_key(url), fields["warc-date"], url, ids[0] or None, kind, ids[1] or None, size, digest, intact))
    return sorted(rows, key=lambda r: (r[3], r[4], r[1]))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives of a folder; those of an archive follow one another as a sorted run."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in RUN.split(", "))])
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _captures(batch.column(0)[i].as_py().rpartition("/")[2], batch.column(1)[i].as_py())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, RUN)


class LoserTree:
    """Merges sorted lists of keys: each inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, keys: list, slices: list[tuple[int, int]]) -> None:
        self.keys, self.at, self.ends = keys, [a for a, _ in slices], [b for _, b in slices]
        self.losers = [-1] * max(1, len(slices))
        self.winner = self._play(1) if len(slices) > 1 else 0

    def _beats(self, one: int, other: int) -> bool:
        """Whether slice `one` comes before; spent slices come last, equal keys by slice."""
        if self.at[one] >= self.ends[one] or self.at[other] >= self.ends[other]:
            return self.at[one] < self.ends[one]
        a, b = self.keys[self.at[one]], self.keys[self.at[other]]
        return a < b or a == b and one < other

    def _play(self, node: int) -> int:
        """The winner of a node's first matches; leaves are the nodes from len(at) on."""
        if node >= len(self.at):
            return node - len(self.at)
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, self.losers[node] = (left, right) if self._beats(left, right) else (right, left)
        return won

    def merged(self) -> Iterator[int]:
        """The places of all keys in merged order."""
        while self.at and self.at[self.winner] < self.ends[self.winner]:
            yield self.at[self.winner]
            self.at[self.winner] += 1
            climber, node = self.winner, (self.winner + len(self.at)) // 2
            while node >= 1 and len(self.at) > 1:
                if self._beats(self.losers[node], climber):
                    climber, self.losers[node] = self.losers[node], climber
                node //= 2
            self.winner = climber


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs' columns with part and place: ascending by both, all captures are in order of URL key, time, archive and offset.

    A task holds the index entries of one range. Where several tasks have read a run, its slice falls into several sorted pieces.
    """
    spark = runs.sparkSession
    rows = runs.count()
    tasks = max(-(-rows // MERGE_ROWS), min(-(-rows // 1000), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    order = ["url_key", "captured", "archive", "offset"]
    names = [f.split()[0] for f in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = list(zip(*(table.column(c).to_pylist() for c in order), strict=True))
        cuts = [i for i in range(1, len(keys)) if keys[i][2] != keys[i - 1][2] or keys[i] < keys[i - 1]]
        slices = list(zip([0, *cuts], [*cuts, len(keys)], strict=True)) if keys else []
        taken = np.fromiter(LoserTree(keys, slices).merged(), np.int64, len(keys))
        part = TaskContext.get().partitionId()
        merged = table.take(taken).append_column("part", pa.array(np.full(len(keys), part, np.int32))).append_column("place", pa.array(np.arange(len(keys))))
        yield from merged.to_batches(max_chunksize=10_000)

    return runs.select(*names).repartitionByRange(tasks, *order).mapInArrow(run, f"{RUN}, part int, place long")


def archive(pages: DataFrame, captured: Column, folder: str | None = None, least: int = LEAST_KEPT) -> DataFrame:
    """The ordered index of new archives of pages (page_id, url, html): one row per page, read back from the archives.

    Columns: those of the runs (archive, offset, length, url_key, captured, url, record_type, payload_bytes, payload_digest,
    intact), page_id and refers_to in page_id's type, part and place (merge_runs). payload_bytes and payload_digest are of the
    full payload, also for revisits; intact says whether a response's payload has the digest that its record states.

    Null html is an empty payload; texts of any length are one record; null page_ids stay null; repeated rows are records each;
    urls that are null or have no `://` have the key `)/`; an empty table gives an empty result. Other columns aren't read.
    Archives lie in `folder`, by default a new one in the shared folder, and stay there.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, captured, folder, least)
    index = merge_runs(materialize(read_runs(spark, folder), "warc-runs"))
    kind = pages.schema["page_id"].dataType
    return index.select(*[c for c in index.columns if c not in ("record_id", "refers_to")], F.url_decode("record_id").cast(kind).alias("page_id"), F.url_decode("refers_to").cast(kind).alias("refers_to"))
