"""String functions: instructions, ids, paths, prompts and answer letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompts, lexicons and ordered classifications.
BENCHMARK_PROMPT = "Answer the following multiple choice question by selecting the letter (A, B, C, D, or E). ONLY output the correct option letter, i.e., A, B, C, D, E. "
FINETUNE_PROMPT = "Answer the following multiple choice question by selecting the letter (A, B, C, or D) only. "
EXTRACTION_DEMO = (
    "Please read the following example. Then extract the answer from the model response and type it at the end of the prompt.\n\n"
    "Hint: Please answer the question and provide the correct option letter, e.g., A, B, C, D, at the end.\n"
    "Question: What fraction of the shape is blue?\nChoices:\n(A) 3/11\n(B) 8/11\n(C) 6/11\n(D) 3/5\n\n"
    "Model response: The correct answer is (B) 8/11.\n\nExtracted answer: B"
)
SOURCE_CLASSES = (
    ("fractal20220817_data", "fractal"),
    ("stanford_kuka_multimodal_dataset_converted_externally_to_rlds", "stanford_kuka"),
    ("austin_sirius_dataset_converted_externally_to_rlds", "austin_sirius"),
    ("berkeley_fanuc_manipulation", "berkeley_fanuc"),
    ("taco_play", "taco_play"),
    ("berkeley_autolab_ur5", "berkeley_autolab"),
)
SCENES = ("office", "kitchen", "lab")
TASKS = ("pick", "place", "push", "pull", "grasp", "move")
PLACE_WORDS = ("from", "on", "onto", "in", "into", "to", "at", "under", "near", "behind", "beside", "towards")
MODEL_FAMILIES = (
    ("llava-1.5", "llava"), ("llava-v1.6", "llava-next"), ("llava-next", "llava-next"), ("qwen2.5", "qwen2_5_vl"), ("qwen2", "qwen2_vl"), ("qwen", "qwen_vl"),
    ("llama-4", "llama4"), ("llama-3.2", "mllama"), ("gemma-3", "gemma3"), ("paligemma2", "paligemma2"), ("paligemma", "paligemma"), ("phi-4", "phi4_mm"),
)


def clean_instruction(x: Column) -> Column:
    """Lower case, then dots, then commas, then white space off both ends, in that order."""
    no_dots = F.regexp_replace(F.lower(x), r"^\.+|\.+$", "")
    no_commas = F.regexp_replace(no_dots, r"^,+|,+$", "")
    return F.regexp_replace(no_commas, r"^\s+|\s+$", "")


def sanitize_instruction(x: Column) -> Column:
    """Letters, digits, spaces and underscores stay, anything else becomes an underscore; no trailing white space."""
    return F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N} _]", "_"), r"\s+$", "")


def output_name(dataset: Column, instruction: Column, position: Column) -> Column:
    return F.concat_ws("_", dataset, sanitize_instruction(instruction), (position + 1).cast("string"))


def episode_id_of_path(path: Column) -> Column:
    """The folder of trajectory.h5, else the last but one part, else ``unknown``."""
    named = F.nullif(F.regexp_extract(path, r"([^/]+)/trajectory\.h5$", 1), F.lit(""))
    return F.coalesce(named, F.nullif(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")), F.lit("unknown"))


def raw_folder(path: Column, marker: str = "droid_raw/1.0.1/") -> Column:
    """What follows the marker, else the last four parts, else null; without the file's name."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    parts = F.split(folder, "/")
    found = F.instr(folder, marker)
    tail = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, -4, 4), "/"))
    return F.when(found > 0, F.substring(folder, found + F.lit(len(marker)), F.length(folder))).otherwise(tail)


def clean_trajectory_id(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[^\w\-]", "_")


def unique_id(trajectory: Column, position: Column) -> Column:
    return F.concat(clean_trajectory_id(trajectory), F.lit("_q"), (position + 1).cast("string"))


def reason_dataset(status: Column) -> Column:
    """What stands in the first brackets of a status text."""
    return F.coalesce(F.nullif(F.regexp_extract(status, r"\(([^)]+)\)", 1), F.lit("")), F.lit("unknown"))


def classify_source(path: Column) -> Column:
    out = F.when(F.contains(F.lower(path), F.lit("droid")), "droid")
    for part, name in SOURCE_CLASSES:
        out = out.when(F.contains(path, F.lit(part)), name)
    return out.otherwise("other")


def model_family(model: Column) -> Column:
    """The loader of a model id; null if no family fits."""
    out = F.when(F.lit(False), F.lit(""))
    for part, name in MODEL_FAMILIES:
        out = out.when(F.contains(F.lower(model), F.lit(part)), name)
    return out


def model_slug(model: Column) -> Column:
    return F.translate(model, "/:", "__")


def path_success(path: Column) -> Column:
    return F.coalesce(F.contains(F.lower(path), F.lit("success")), F.lit(False))


def letter(index: Column) -> Column:
    return F.chr(index + F.lit(65))


def mcq_benchmark(question: Column, choices: Column) -> Column:
    """The question with at most five choices in one line."""
    shown = F.transform(F.slice(choices, 1, 5), lambda c, i: F.concat(F.lit(" "), letter(i), F.lit(". "), c))
    return F.concat(question, F.array_join(shown, ""))


def mcq_finetune(question: Column, choices: Column) -> Column:
    """The question with a line for each choice."""
    shown = F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(". "), c, F.lit("\n")))
    return F.concat(question, F.lit("\nChoices:\n"), F.array_join(shown, ""))


def extraction_prompt(query: Column, response: Column) -> Column:
    return F.concat(F.lit(EXTRACTION_DEMO + "\n\n"), query, F.lit("\n\n"), response, F.lit("\n\nExtracted answer: "))


def letter_last(response: Column) -> Column:
    """The last word-bounded A-E, else the cleaned text."""
    x = F.regexp_replace(response, r"^\n+|\n+$", "")
    for pattern in (r"\.+$", r"/+$", r"^ +| +$", r"^:+"):
        x = F.regexp_replace(x, pattern, "")
    found = F.try_element_at(F.regexp_extract_all(F.upper(x), F.lit(r"\b([A-E])\b"), F.lit(1)), F.lit(-1))
    rest = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^\.+|\.+$", "")
    return F.regexp_replace(F.regexp_replace(F.coalesce(found, rest), r"\.+$", ""), "/+$", "")


def letter_first(response: Column) -> Column:
    """The first A-E of any case, wherever it stands; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(response, "(?i)[A-E]", 0)), F.lit(""))


def letter_bounded(response: Column) -> Column:
    """The last word-bounded A-E or null: the extraction to prefer."""
    return F.try_element_at(F.regexp_extract_all(F.upper(response), F.lit(r"\b([A-E])\b"), F.lit(1)), F.lit(-1))


def is_correct(found: Column, expected: Column) -> Column:
    return F.coalesce(found == F.upper(expected), F.lit(False))


def tag_of(metadata_tag: Column, question_id: Column) -> Column:
    """The item's tag, else the id's first part, else ``general`` for a missing id."""
    return F.coalesce(F.nullif(metadata_tag, F.lit("")), F.split_part(question_id, F.lit("_"), F.lit(1)), F.lit("general"))


def cache_key(model: Column, question_id: Column) -> Column:
    return F.concat_ws("::", model, question_id)


def json_in_text(response: Column) -> Column:
    """The widest {...} of a model's answer."""
    return F.nullif(F.regexp_extract(response, r"(\{[\s\S]*\})", 1), F.lit(""))


def scene_fallback(description: Column) -> Column:
    """Scene by keyword where a model's answer can't be read."""
    low = F.lower(description)
    return F.when(F.contains(low, F.lit("office")), "office").when(F.contains(low, F.lit("kitchen")), "kitchen").when(F.contains(low, F.lit("lab")), "lab").otherwise("unknown")


def task_fallback(description: Column) -> Column:
    """The first task word, in their fixed order, that a description holds; empty if none."""
    low = F.lower(description)
    out = F.when(F.lit(False), F.lit(""))
    for word in TASKS:
        out = out.when(F.contains(low, F.lit(word)), word)
    return out.otherwise("")


def description(response: Column) -> Column:
    """physical_location, task, target_object, location of a vision model's answer: its JSON, missing keys empty; else by keywords."""
    keys = ("physical_location", "task", "target_object", "location")
    read = F.from_json(json_in_text(response), "map<string,string>")
    scene = scene_fallback(response)
    spoken = (F.when(scene == "unknown", "").otherwise(scene), task_fallback(response), F.lit(""), F.lit(""))
    return F.struct(*[F.when(read.isNotNull(), F.coalesce(F.try_element_at(read, F.lit(k)), F.lit(""))).otherwise(F.coalesce(x, F.lit(""))).alias(k) for k, x in zip(keys, spoken, strict=True)])


def _plain(instruction: Column) -> Column:
    return F.regexp_replace(F.lower(instruction), r"[^\p{L}\p{N} ]", "")


def nouns(instruction: Column) -> Column:
    """What follows each article, in order and once; the last word of an instruction without articles."""
    found = F.array_distinct(F.regexp_extract_all(_plain(instruction), F.lit(r"(?:^| )(?:the|a|an) ([^ ]+)"), F.lit(1)))
    return F.when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(first_noun(instruction))))


def places(instruction: Column) -> Column:
    """What follows a word of place and an article, in order and once."""
    return F.array_distinct(F.regexp_extract_all(_plain(instruction), F.lit(r"(?:^| )(?:" + "|".join(PLACE_WORDS) + r") (?:the|a|an) ([^ ]+)"), F.lit(1)))


def first_noun(instruction: Column) -> Column:
    """A rule in place of a parser: what follows the first article, else the last word, without punctuation."""
    plain = F.regexp_replace(F.lower(instruction), r"[^\p{L}\p{N} ]", "")
    after = F.regexp_extract(plain, r"(?:^| )(?:the|a|an) ([^ ]+)", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.nullif(F.regexp_extract(plain, r"([^ ]+) *$", 1), F.lit("")))


def conversation(question: Column, choices: Column, correct: Column) -> Column:
    """User and assistant messages; a correct letter that is none of A-E counts as A."""
    at = F.coalesce(F.nullif(F.instr(F.lit("ABCDE"), correct), F.lit(0)), F.lit(1))
    answer = F.concat(correct, F.lit(". "), F.try_element_at(choices, at))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    return F.array(
        F.struct(F.lit("user").alias("role"), F.array(part("image", F.lit(None).cast("string")), part("text", mcq_finetune(question, choices))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(part("text", answer)).alias("content")),
    )


def safe_path(json: Column, path: str, default: str | None = None) -> Column:
    """A value by JSON path, or the default."""
    got = F.get_json_object(json, path)
    return got if default is None else F.coalesce(got, F.lit(default))
