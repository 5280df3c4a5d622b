"""Channel archives, paged backwards, as a streaming source that resumes where it stopped.

Pages of a channel lie in folder/channel=C/before=N: the page that was asked for with "older than post N". Its own oldest post
is the next page's N, so a channel's pages form a chain towards its beginning. A landing job may pack pages that follow each
other: folder/channel=C/run=N-K holds K of them, newest first, as lines {"before": N, "html": ...}, and N is the newest one's.
The offset of the stream holds how far each channel has come; Spark commits it with each batch, so that a stream that stops, or
loses a task, goes on without gaps and without posts seen twice. A batch takes some pages of each channel, or one run where
that holds more, and deals about TASK_PAGES to a task. A channel's folder is listed again only when what is known of it
doesn't fill a batch. A page is checked where it is read: its posts are older than its N and none is older than the next N.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feeds import channel_posts
from .shared import by_value, folders, text_of


#: Pages of a task, so that small ones don't cost a worker and a file each; ids of a channel that a landing task holds.
TASK_PAGES, LANDED_IDS = 16, 1 << 16


class Pages(InputPartition):
    """Folders of a channel that follow each other, each with its N and the N behind it."""

    def __init__(self, channel: str, landed: list[tuple[str, int, int]]):
        self.channel, self.landed = channel, landed


class ChannelArchive(DataSource):
    """spark.readStream.format("channel_archive").load(folder); options: pages (of a channel in a batch), channels (joined by commas)."""

    @classmethod
    def name(cls) -> str:
        return "channel_archive"

    def schema(self) -> str:
        return "channel string, before long, until long, html string"

    def streamReader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.pages = options["path"].rstrip("/"), int(options.get("pages", 4))
        self.channels, self.now = options.get("channels"), None
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def landed(self) -> dict[str, str]:
        """The folder of each channel."""
        wanted = self.channels.split(",") if self.channels else None
        return {c: f"{self.path}/{f}" for c, f in sorted(by_value(self.path, "channel").items()) if wanted is None or c in wanted}

    @staticmethod
    def chain(folder: str) -> list[tuple[int, int, str]]:
        """What a channel's folder holds so far, newest first: N, the number of pages, and where they lie."""
        out = []
        for name in folders(folder):
            kind, _, value = name.partition("=")
            if kind == "before":
                out.append((int(value), 1, f"{folder}/{name}"))
            elif kind == "run":
                newest, _, pages = value.rpartition("-")
                out.append((int(newest), int(pages), f"{folder}/{name}"))
        return sorted(out, reverse=True)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each channel the page it has come to: `pages` further than before, where so many have landed."""
        now = dict(self.now or {})
        for channel, folder in self.landed().items():
            last = now.get(channel, 1 << 62)
            ahead = [x for x in self.known.get(channel, []) if x[0] < last]
            if sum(n for _, n, _ in ahead[:-1]) < self.pages:  # the one behind a batch has to be known, too
                self.known[channel] = self.chain(folder)
                ahead = [x for x in self.known[channel] if x[0] < last]
            else:
                self.known[channel] = ahead
            taken = 0
            for before, n, _ in ahead:
                if taken and taken + n > self.pages:
                    break
                now[channel], taken = before, taken + n
        self.now = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.now is None:  # after a restart: go on from what is committed
            self.now = dict(end)
        out, landed = [], None
        for channel, upto in end.items():
            first = start.get(channel, 1 << 62)
            if upto == first:
                continue
            chain = self.known.get(channel)
            if chain is None:
                landed = self.landed() if landed is None else landed
                chain = self.chain(landed[channel])
            held: list[tuple[str, int, int]] = []
            size = 0
            for (before, n, folder), until in zip(chain, [*(x[0] for x in chain[1:]), 0]):
                if upto <= before < first:
                    if held and size + n > TASK_PAGES:
                        out.append(Pages(channel, held))
                        held, size = [], 0
                    held.append((folder, before, until))
                    size += n
            if held:
                out.append(Pages(channel, held))
        return out

    def read(self, partition: Pages):
        for folder, before, until in partition.landed:
            text = text_of(folder)
            if "/run=" not in folder[folder.rindex("/") :]:
                yield partition.channel, before, until, text
                continue
            pages = [json.loads(line) for line in text.split("\n") if line]
            if not pages or pages[0]["before"] != before or len(pages) != int(folder.rpartition("-")[2]):
                raise ValueError(f"{folder}: the run isn't whole")
            for page, behind in zip(pages, [*(p["before"] for p in pages[1:]), until]):
                yield partition.channel, page["before"], behind, page["html"]

    def commit(self, end: dict) -> None:
        """Pages stay: nothing is to be given back."""


def archived_posts(spark: SparkSession, folder: str, since: str | None = None, **options) -> DataFrame:
    """A stream of channel, message_id, published, text and edited; posts before `since` are left out.

    A post that is not older than its page's N, or older than the next page's, stops the stream: the chain is broken.
    """
    spark.dataSource.register(ChannelArchive)
    posts = channel_posts(spark.readStream.format("channel_archive").options(**options).load(folder))
    number = F.substring_index("post_id", "/", -1).try_cast("long")
    sound = (number < F.col("before")) & (number >= F.col("until")) & (F.lower(F.substring_index("post_id", "/", 1)) == F.lower("channel"))
    checked = F.when(F.coalesce(sound, F.lit(False)), number).otherwise(F.raise_error(F.concat(F.lit("post out of its page: "), "post_id")).cast("long"))
    out = posts.select("channel", checked.alias("message_id"), "published", "text", "edited")
    return out if since is None else out.where(F.col("published") >= F.lit(since).cast("timestamp"))


def land_archive(posts: DataFrame, folder: str, page_posts: int = 20, run_pages: int = 1) -> None:
    """Write posts (channel, message_id, published, text, edited) as pages, as a landing job would leave them: for tests and queries.

    Posts are paged within ranges of ids, so that no task holds a channel. With `run_pages` above 1 so many pages at most lie
    in one file: a folder and a file for each page cost more than what is in them.
    """
    from pyspark.sql import Window

    kept = posts.withColumn("__part", F.floor(F.col("message_id") / LANDED_IDS))
    within = Window.partitionBy("channel", "__part").orderBy("message_id")
    page = F.floor((F.row_number().over(within) - 1) / page_posts)
    edited = F.when(F.col("edited"), '<span class="message_meta">edited </span>').otherwise('<span class="message_meta"></span>')
    stamp = F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    post = F.concat(
        F.lit('<div class="message" data-post="'), F.col("channel"), F.lit("/"), F.col("message_id").cast("string"), F.lit('"><div class="message_text">'), safe, F.lit("</div>"), edited,
        F.lit('<time datetime="'), stamp, F.lit('"></time></div>'),
    )
    pages = kept.withColumn("__page", page).groupBy("channel", "__part", "__page").agg(F.min("message_id").alias("oldest"), F.max("message_id").alias("newest"), F.array_join(F.array_sort(F.collect_list(post)), "").alias("value"))  # page_posts at most
    # A page is named by the oldest post of the one before it; the newest by its own newest post and one. Only a number a range meets in a channel.
    starts = kept.groupBy("channel", "__part").agg(F.min("message_id").alias("first"))
    starts = starts.select("channel", "__part", F.lead("first").over(Window.partitionBy("channel").orderBy("__part")).alias("behind"))
    following = F.coalesce(F.lead("oldest").over(Window.partitionBy("channel", "__part").orderBy("__page")), "behind", F.col("newest") + 1)
    named = pages.join(starts, ["channel", "__part"]).withColumn("before", following).withColumn("value", F.concat(F.lit("<html>"), "value"))
    if run_pages == 1:
        named.select("channel", "before", "value").write.partitionBy("channel", "before").text(folder)
        return
    line = F.struct((-F.col("before")).alias("at"), F.to_json(F.struct("before", F.col("value").alias("html"))).alias("line"))
    runs = named.groupBy("channel", "__part", F.floor(F.col("__page") / run_pages).alias("__run")).agg(F.max("before").alias("before"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(line)).alias("lines"))  # run_pages at most
    lines = runs.select("channel", F.concat_ws("-", "before", "n").alias("run"), F.array_join("lines.line", "\n").alias("value"))
    lines.write.partitionBy("channel", "run").text(folder)
