"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes is summed to one row per key: inserts add a document and its tokens, deletes
take them away, revised counts add the difference. The sums are additive, so the totals are the
sums of all committed batches. A batch has an id and replaces itself when it is committed again, so a
repeated commit changes nothing. ``compact`` folds batches into one; commits of their ids, and of the
new one, are refused afterwards.

Cases: null keys are keys; null token counts count as none; deleting what was never inserted makes
totals negative, which shows the mistake; keys whose documents and tokens are both zero are left
out of the totals; empty batches are batches. Repeated rows are changes of their own. Only the
columns named below are read.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfathom.plans.scale import last_number

from .common import kept, text_of

KEYS = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"
DELTA_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

def token_count(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with ``tokens``, counted with a rank file that every executor can open."""
    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        def load() -> tiktoken.Encoding:
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
            return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        encode = kept(("counted", path, pattern), load).encode_ordinary
        for part in texts:
            yield part.map(lambda text: len(encode(text))).astype("int64")

    return docs.withColumn("tokens", count(text_of()))


def deltas(changes: DataFrame) -> DataFrame:
    """Sums of a batch. ``changes``: the keys, change, tokens, and old_tokens of revised counts."""
    sign = (F.when(F.col("change") == INSERT, 1).when(F.col("change") == DELETE, -1)
            .when(F.col("change") == REVISE, 0))
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))
    known = F.when(sign.isNull(), F.raise_error(F.lit("unknown change"))).otherwise(sign)
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(
        F.sum(known).cast("long").alias("docs"),
        F.sum(F.when(F.col("change") == REVISE, tokens - old).otherwise(sign * tokens))
        .cast("long").alias("tokens"))


class TokenTotals:
    """Totals kept in a folder that all executors share.

    ``manifests`` holds numbered snapshots: which folder of ``parts`` each live batch is in, and the
    ids that are closed. A part is written first and becomes visible with the next manifest, which is
    written whole and renamed to a number that nobody has taken; the largest number counts. Readers
    thus see all of a commit or a compaction or nothing, and whatever a crash leaves behind is never
    read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        number = last_number(self.spark, f"{self.path}/manifests", "number")
        if number is None:
            return 0, {"live": {}, "closed": []}
        text = self.spark.read.text(f"{self.path}/manifests/number={number}", wholetext=True).first()[0]
        return number, json.loads(text)

    def _publish(self, change: Callable[[dict], dict]) -> None:
        """Replace the manifest by what ``change`` makes of it; anew if another writer was faster."""
        path, files = self._files()
        while True:
            number, state = self._manifest()
            draft = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
            out = files.create(draft)
            out.write(json.dumps(change(state)).encode())
            out.close()
            final = path(f"{self.path}/manifests/number={number + 1}")
            files.mkdirs(final.getParent())
            if not files.exists(final) and files.rename(draft, final):
                return
            files.delete(draft, False)

    def _written(self, batch: str, rows: DataFrame) -> str:
        name = f"{batch}.{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.path}/parts/{name}")
        return name

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Add a batch; committing the same batch again replaces it, until it is compacted."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id is made of letters, digits, - and _")

        def added(state: dict) -> dict:
            if batch in state["closed"]:
                raise ValueError(f"batch {batch} has been compacted")
            return state | {"live": state["live"] | {batch: name}}

        name = ""
        added(self._manifest()[1])
        name = self._written(batch, deltas(changes))
        self._publish(added)

    def compact(self, into: str) -> None:
        """Fold all live batches into one under a new id. Their ids and the new one are closed: later
        commits of them are refused."""
        state = self._manifest()[1]
        if into in state["live"] or into in state["closed"]:
            raise ValueError(f"batch id {into} is in use")
        folded = state["live"]
        name = self._written(into, self._sums(folded).filter("docs <> 0 OR tokens <> 0"))

        def replaced(now: dict) -> dict:
            if any(now["live"].get(batch) != part for batch, part in folded.items()) or into in now["closed"]:
                raise ValueError("batches changed while they were compacted")
            left = {batch: part for batch, part in now["live"].items() if batch not in folded}
            return {"live": left | {into: name}, "closed": sorted({*now["closed"], *folded, into})}

        self._publish(replaced)

    def vacuum(self) -> None:
        """Delete parts that no manifest but the last names, and older manifests; while nobody reads
        an older snapshot or writes."""
        path, files = self._files()
        number, state = self._manifest()
        live = set(state["live"].values())
        for folder, keep in (("parts", live), ("manifests", {f"number={number}"}), ("drafts", set())):
            where = path(f"{self.path}/{folder}")
            if files.exists(where):
                for status in files.listStatus(where):
                    if status.getPath().getName() not in keep:
                        files.delete(status.getPath(), True)

    def _sums(self, live: dict[str, str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], DELTA_SCHEMA)
        return (self.spark.read.schema(DELTA_SCHEMA).parquet(*[f"{self.path}/parts/{name}" for name in live.values()])
                .groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all committed batches."""
        return self._sums(self._manifest()[1]["live"]).filter((F.col("docs") != 0) | (F.col("tokens") != 0))
