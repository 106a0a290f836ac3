"""Writers: item folders with pictures and metadata, and result files.

Item folders go through a data source of their own (``ItemFolders``): tasks write episodes aside, and what they wrote shows when all
are done, with a line of a manifest for each; a failed job or task leaves nothing, and reading the result writes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .staged import StagedWriter, system_of

WRITTEN = "dataset string, episode_id string, items int, images int, folder string"
MANIFEST = "_manifest"
FILE = "dataset string, episode_id string, name string, content binary, items int, images int"


class FolderWriter(StagedWriter):
    """Files of FILE, of which an episode's come one after another, as <target>/<dataset>/<episode_id>/<name>; an episode that is there is replaced."""

    def __init__(self, target, overwrite, manifest: str):
        super().__init__(target, overwrite)
        self.manifest = manifest

    def put(self, batches, system, folder):
        told: dict[tuple[str, str], list[int]] = {}
        made: set[str] = set()
        for b in batches:
            for dataset, episode, name, content, items, images in zip(*[b.column(c) for c in ("dataset", "episode_id", "name", "content", "items", "images")], strict=True):
                key = (dataset.as_py(), episode.as_py())
                at = "/".join((folder, *key, *name.as_py().split("/")[:-1]))
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                with system.open_output_stream("/".join((folder, *key, name.as_py()))) as f:
                    f.write(content.as_buffer())
                n = told.setdefault(key, [0, 0])
                n[0] += items.as_py()
                n[1] += images.as_py()
        if not told:
            return [], {}
        line = f"{MANIFEST}/{self.manifest}/{uuid.uuid4().hex}.json"
        system.create_dir(f"{folder}/{MANIFEST}/{self.manifest}", recursive=True)
        rows = [{"dataset": d, "episode_id": e, "items": i, "images": p, "folder": f"{self.target}/{d}/{e}"} for (d, e), (i, p) in told.items()]
        with system.open_output_stream(f"{folder}/{line}") as f:
            f.write("\n".join(map(json.dumps, rows)).encode())
        return [line, *(f"{d}/{e}" for d, e in told)], {"episodes": len(told)}

    def commit(self, messages):
        from pyarrow import fs

        system, path = system_of(self.target)
        for m in messages:
            for name in m.names if m is not None else []:
                if not name.startswith(MANIFEST) and system.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
                    system.delete_dir(f"{path}/{name}")
        super().commit(messages)


class ItemFolders(DataSource):
    @classmethod
    def name(cls):
        return "itemfolders"

    def writer(self, schema, overwrite):
        return FolderWriter(self.options["path"], overwrite, self.options["manifest"])


def episode_files(items: DataFrame, images: DataFrame, metadata: DataFrame) -> DataFrame:
    """FILE: vqa_data.json and metadata.json of each episode with items, and its pictures; one with pictures alone has these."""
    own = [F.col(c).cast("string").alias(c) for c in ("dataset", "episode_id")]
    told = metadata.select(*own, "language_instruction")
    choices = F.transform("choices", lambda c, i: F.struct(c.alias("text"), F.lit(None).cast("string").alias("image_id"), (i == F.col("correct_answer")).alias("is_correct")))
    question = F.struct(F.col("question").alias("text"), F.coalesce("image_ids", F.array().cast("array<string>")).alias("image_ids"))
    item = F.struct(question.alias("question"), choices.alias("choices"), F.struct("tag").alias("metadata"))
    keyed = items.select(*own, F.struct("step", "rank", "tag", item.alias("item")).alias("x"))
    whole = keyed.groupBy("dataset", "episode_id").agg(F.sort_array(F.collect_list("x")).alias("x")).join(told, ["dataset", "episode_id"], "left")
    about = F.struct("language_instruction", "episode_id", "dataset").alias("metadata")
    keep = {"ignoreNullFields": "false"}
    file = lambda name, content, n: F.struct(F.lit(name).alias("name"), content.cast("binary").alias("content"), n.cast("int").alias("items"))
    both = F.array(file("vqa_data.json", F.to_json(F.struct(F.col("x.item").alias("vqa_items"), about), keep), F.size("x")), file("metadata.json", F.to_json(about, keep), F.lit(0)))
    texts = whole.select("dataset", "episode_id", F.explode(both).alias("f")).select("dataset", "episode_id", "f.*", F.lit(0).alias("images"))
    each = images.dropDuplicates(["dataset", "episode_id", "image_id"])
    pictures = each.select(*own, F.concat(F.lit("images/"), "image_id", F.lit(".png")).alias("name"), F.col("png").alias("content"), F.lit(0).alias("items"), F.lit(1).alias("images"))
    return texts.unionByName(pictures)


def write_items(items: DataFrame, images: DataFrame, metadata: DataFrame, base: str) -> DataFrame:
    """Writes base/<dataset>/<episode_id>/ with vqa_data.json, images/<image_id>.png and metadata.json for every episode, and returns the manifest.

    ``items``: dataset, episode_id, step, rank, tag, question, choices, correct_answer, image_ids, in order of step, rank
    and tag; ``images``: dataset, episode_id, image_id, png, one row a picture; ``metadata``: dataset, episode_id, language_instruction.
    An episode's files are written by one task, a picture at a time.  All episodes show together when the job is done; one that was there is replaced.
    """
    spark, manifest = items.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ItemFolders)
    files = episode_files(items, images, metadata).repartition("dataset", "episode_id").sortWithinPartitions("dataset", "episode_id")
    files.write.format("itemfolders").mode("append").option("manifest", manifest).save(base)
    at = f"{base}/{MANIFEST}/{manifest}"
    system, path = system_of(at)
    from pyarrow import fs

    if system.get_file_info(path).type == fs.FileType.NotFound:  # nothing to write
        return spark.createDataFrame([], WRITTEN)
    return spark.read.schema(WRITTEN).json(f"{at}/*.json")


def write_results(summaries: DataFrame, responses: DataFrame, path: str) -> None:
    """path/summaries: a JSON line for each model (of ``results_json``); path/responses: its scored answers as JSON lines, in a folder for each model.

    Answers are rows of their own, as their number has no bound that one file of a model could hold.
    """
    summaries.select(F.col("result").alias("value")).write.mode("overwrite").text(f"{path}/summaries")
    responses.write.mode("overwrite").partitionBy("model").json(f"{path}/responses")


def write_comparison(pairs: DataFrame, by_tag: DataFrame, path: str) -> None:
    """path/pairs and path/tags: how models differ, and accuracy by tag and model, as JSON lines."""
    pairs.write.mode("overwrite").json(f"{path}/pairs")
    by_tag.write.mode("overwrite").json(f"{path}/tags")
