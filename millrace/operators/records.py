"""Projections of conversations and candidates, checks of their shape, and hashes that identify them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import is_blank, normalized

ROLES = ("system", "user", "assistant")


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation: its ``messages`` (structs of role and content) in order. A conversation is one row of one task."""
    message = F.struct(turn, F.col("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(message)).alias("m"))
    return listed.select(conv, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def user_turns(messages: Column) -> Column:
    """Turns of the user."""
    return F.size(F.filter(messages, lambda m: m["role"] == "user")).cast("long")


def conversation_text(messages: Column) -> Column:
    """``[role] content`` of each message, blank lines between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("] "), m["content"])), "\n\n")


def without_system(messages: Column) -> Column:
    """Messages of the others than the system."""
    return F.filter(messages, lambda m: m["role"] != "system")


def system_text(messages: Column) -> Column:
    """The system's messages, one a line."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), "\n\n")


def alternates(history: Column) -> Column:
    """Whether a history without system messages has user and assistant in turn, user first and assistant last; an empty one does."""
    wanted = F.transform(history, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return F.forall(wanted, lambda x: x) & (F.size(history) % 2 == 0)


def shape_problems(messages: Column, min_messages: int = 3, max_system_chars: int = 400) -> Column:
    """What is wrong with a chat record, as codes."""
    first, last = F.get(messages, F.lit(0)), F.get(messages, F.size(messages) - 1)
    systems = F.filter(messages, lambda m: m["role"] == "system")
    rules = {
        "too_few_messages": F.size(messages) < min_messages,
        "system_not_first": ~F.coalesce(first["role"] == "system", F.lit(False)),
        "assistant_not_last": ~F.coalesce(last["role"] == "assistant", F.lit(False)),
        "unknown_role": F.exists(messages, lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))),
        "blank_message": F.exists(messages, lambda m: is_blank(m["content"])),
        "several_system_messages": F.size(systems) > 1,
        "long_system_message": F.exists(systems, lambda m: F.length(m["content"]) > max_system_chars),
        "roles_do_not_alternate": ~alternates(without_system(messages)),
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def rendered_conversation(history: Column, message: Column, code: Column, language: Column) -> Column:
    """The history and the user's message, the code in a fence before the first user turn only, contents stripped."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    fenced = F.concat(F.lit("```"), language, F.lit("\n"), strip(code), F.lit("\n```\n\n"))
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    told = F.transform(history, lambda m, i: turn(m["role"], F.when(i == 0, F.concat(fenced, strip(m["content"]))).otherwise(m["content"])))
    asked = turn(F.lit("user"), F.when(F.size(history) == 0, F.concat(fenced, strip(message))).otherwise(strip(message)))
    return F.concat(told, F.array(asked))


def chat_record(system: Column, messages: Column, answer: Column) -> Column:
    """The messages with a system prompt before (if it is not empty) and the stripped answer after."""
    turn = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    strip = F.regexp_replace(answer, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    body = F.concat(messages, turn("assistant", strip))
    return F.when(F.coalesce(system, F.lit("")) == "", body).otherwise(F.concat(turn("system", system), body))


def learner_state(solved: Column, pressure: Column) -> Column:
    """solved, almost_correct or unresolved."""
    return F.when(solved, "solved").when(pressure == "almost_correct", "almost_correct").otherwise("unresolved")


def scenario_hash(code: Column, message: Column, history: Column) -> Column:
    """SHA-256 of the normalised code, message and contents of the history, one a line; the last line may be empty."""
    told = F.array_join(F.transform(history, lambda m: normalized(m["content"])), "\n")
    return F.sha2(F.concat_ws("\n", normalized(code), normalized(message), told), 256)


def candidate_hash(scenario: Column, response: Column) -> Column:
    """SHA-256 of the hash of the scenario and the normalised response."""
    return F.sha2(F.concat_ws("\n", scenario, normalized(response)), 256)


def verdict_key(scenario: Column, response: Column) -> Column:
    """SHA-256 of the hash of the scenario and the response with single spaces, letter case kept."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(response, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "), "^ | $", "")
    return F.sha2(F.concat_ws("\n", scenario, plain), 256)


def canonical_json(messages: Column) -> Column:
    """Messages as JSON with sorted keys and a space after commas and colons, characters beyond ASCII kept."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    one = lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]"))


def set_fingerprint(df: DataFrame, digest: Column) -> DataFrame:
    """One row, ``n`` and ``fingerprint``: of the SHA-256 digests of all rows, in whatever order they are.

    The digests are added up in four parts of 60 bits, so that partial sums merge and nothing is gathered.
    """
    part = lambda k: F.sum(F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
    sums = [F.coalesce(part(k), F.lit(0).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("-", *sums), 256).alias("fingerprint"))


def order_fingerprint(df: DataFrame, rank: Column, digest: Column) -> DataFrame:
    """The same for rows in an order: each digest is that of its rank and row."""
    return set_fingerprint(df, F.sha2(F.concat_ws("\n", rank.cast("string"), digest), 256))


def slug(*parts: Column) -> Column:
    """Parts as one name of lower-case letters and digits with single hyphens between."""
    plain = F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]+", "-")
    return F.regexp_replace(plain, "^-|-$", "")
