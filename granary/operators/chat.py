"""Chat templates, response parsing, format conversion and conversation-to-record adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import twin as D
from ..dual import Book
from ..functions import text as T
from ..twin import S, quoted

BOOK = Book()
add, both = BOOK.add, BOOK.both
read = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

# The marks of the native format.
BEGIN, END = "<|begin|>", "<|end|>"
TURN, TURN_END = "<|turn|>", "<|/turn|>"
SYSTEM, SYSTEM_END = "<|system|>", "<|/system|>"
USER, USER_END = "<|user|>", "<|/user|>"
ASSISTANT, ASSISTANT_END = "<|assistant|>", "<|/assistant|>"
REASON, REASON_END = "<|reason|>", "<|/reason|>"
STEP, STEP_END = "<|step|>", "<|/step|>"
CONCLUDE, CONCLUDE_END = "<|conclude|>", "<|/conclude|>"
CALL, CALL_END = "<|call|>", "<|/call|>"
ARGS, ARGS_END = "<|args|>", "<|/args|>"
RESULT, RESULT_END = "<|result|>", "<|/result|>"

# Marks of the native format and what other formats write for them, in the order of replacement.
CONVERSIONS: dict[str, list[tuple[str, str]]] = {
    "llama3": [
        (BEGIN, "<|begin_of_text|>"), (END, "<|end_of_text|>"), (SYSTEM, "<|start_header_id|>system<|end_header_id|>"), (USER, "<|start_header_id|>user<|end_header_id|>"),
        (ASSISTANT, "<|start_header_id|>assistant<|end_header_id|>"), (USER_END, "<|eot_id|>"), (ASSISTANT_END, "<|eot_id|>"), (CALL, "<|python_tag|>"), (RESULT, "<|start_header_id|>ipython<|end_header_id|>"), (REASON, ""), (REASON_END, ""),
    ],
    "mistral": [(BEGIN, "<s>"), (END, "</s>"), (SYSTEM, "[INST]"), (USER, "[INST]"), (ASSISTANT, ""), (USER_END, "[/INST]"), (ASSISTANT_END, "</s>"), (CALL, "[TOOL_CALLS]"), (RESULT, "[TOOL_RESULTS]"), (REASON, ""), (REASON_END, "")],
    "chatml": [
        (BEGIN, "<|im_start|>"), (END, "<|im_end|>"), (SYSTEM, "<|im_start|>system"), (USER, "<|im_start|>user"), (ASSISTANT, "<|im_start|>assistant"), (USER_END, "<|im_end|>"), (ASSISTANT_END, "<|im_end|>"),
        (CALL, '<|im_start|>assistant\n{"tool_calls":'), (RESULT, "<|im_start|>tool"), (REASON, ""), (REASON_END, ""),
    ],
    "gemma": [
        (BEGIN, "<bos>"), (END, "<eos>"), (SYSTEM, "<start_of_turn>user"), (USER, "<start_of_turn>user"), (ASSISTANT, "<start_of_turn>model"), (USER_END, "<end_of_turn>"), (ASSISTANT_END, "<end_of_turn>"),
        (CALL, "<start_of_turn>model\n```tool_call"), (RESULT, "<start_of_turn>tool"), (REASON, ""), (REASON_END, ""),
    ],
    "deepseek": [(REASON, "<think>"), (REASON_END, "</think>")],
    "qwen": [(REASON, "<think>"), (REASON_END, "</think>")],
}


# ---- operators -----------------------------------------------------------------------------------------------------


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, messages): an array of (role, content) by turn."""
    sorted_ = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))))
    return rows.groupBy(conv).agg(F.transform(sorted_, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _first_system(m: Column) -> Column:
    return F.get(F.filter(m, lambda x: x["role"] == "system"), F.lit(0))["content"]


def native_template(m: Column, generation_prompt: bool = True, reasoning: bool = False, steps: bool = False) -> Column:
    """The native format: begin, the first system message, a turn for each other message, the prompt to go on."""
    block = lambda a, x, b: F.concat(F.lit(a + "\n"), x, F.lit("\n" + b + "\n"))
    system = _first_system(m)

    def turn(x: Column) -> Column:
        inner = F.when(x["role"] == "user", block(USER, x["content"], USER_END)).when(x["role"] == "assistant", block(ASSISTANT, x["content"], ASSISTANT_END)).when(x["role"] == "tool", block(RESULT, x["content"], RESULT_END)).otherwise("")
        return F.concat(F.lit(TURN + "\n"), inner, F.lit(TURN_END + "\n"))

    tail = f"{TURN}\n{ASSISTANT}\n" + (f"{REASON}\n" if reasoning else "") + (STEP if reasoning and steps else "") if generation_prompt else ""
    return F.concat(F.lit(BEGIN + "\n"), F.coalesce(block(SYSTEM, system, SYSTEM_END), F.lit("")), _joined(F.transform(F.filter(m, lambda x: x["role"] != "system"), turn)), F.lit(tail))


def chatml_template(m: Column, generation_prompt: bool = True) -> Column:
    turns = F.transform(m, lambda x: F.concat(F.lit(TURN), x["role"], F.lit("\n"), x["content"], F.lit(TURN_END + "\n")))
    return F.concat(_joined(turns), F.lit(f"{TURN}assistant\n" if generation_prompt else ""))


def llama_template(m: Column, generation_prompt: bool = True) -> Column:
    """Instruction marks; the first system message stands inside the first user turn."""
    system = _first_system(m)
    rest = F.filter(m, lambda x: x["role"] != "system")
    first = F.coalesce(F.array_position(F.transform(rest, lambda x: x["role"]), "user"), F.lit(0))
    lead = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.lit(SYSTEM + "\n"), system, F.lit("\n" + SYSTEM_END + "\n\n"))).otherwise("")
    turn = lambda x, i: F.when(x["role"] == "user", F.concat(F.lit("[INST]"), F.when(i + 1 == first, lead).otherwise(""), x["content"], F.lit("[/INST]"))).when(x["role"] == "assistant", F.concat(F.lit(" "), x["content"], F.lit(" " + END))).otherwise("")
    return F.concat(F.lit(BEGIN), _joined(F.transform(rest, turn)), F.lit(" " if generation_prompt else ""))


def compact_template(m: Column, style: str) -> Column:
    """One-line formats: native, llama3, mistral, chatml, gemma, or `role: content` for any other style."""
    r, c = (lambda x: x["role"]), (lambda x: x["content"])
    one: dict[str, Callable[[Column], Column]] = {
        "native": lambda x: F.when(r(x) == "system", F.concat(F.lit(SYSTEM), c(x))).otherwise(F.concat(F.lit("<|"), r(x), F.lit("|>"), c(x), F.lit("<|/"), r(x), F.lit("|>"))),
        "llama3": lambda x: F.concat(F.lit("<|start_header_id|>"), r(x), F.lit("<|end_header_id|>\n\n"), c(x), F.lit("<|eot_id|>")),
        "mistral": lambda x: F.when(r(x) == "user", F.concat(F.lit("[INST]"), c(x), F.lit("[/INST]"))).otherwise(c(x)),
        "chatml": lambda x: F.concat(F.lit("<|im_start|>"), r(x), F.lit("\n"), c(x), F.lit("<|im_end|>")),
        "gemma": lambda x: F.concat(F.lit("<start_of_turn>"), F.when(r(x) == "assistant", "model").otherwise("user"), F.lit("\n"), c(x), F.lit("<end_of_turn>")),
    }
    return F.array_join(F.transform(m, one.get(style, lambda x: F.concat(r(x), F.lit(": "), c(x)))), "\n" if style == "chatml" else "")


def sft_prompt(m: Column, system: str, user: tuple[str, str], assistant: str, eos: str, default_system: str = "") -> Column:
    """All messages, without empty ones, up to the next assistant prefix; an unknown role raises.

    system: a prefix before system content; default_system stands where no message has one.
    """
    full = F.filter(F.transform(m, lambda x: F.struct(F.lower(T.strip(x["role"])).alias("role"), T.strip(x["content"]).alias("content"))), lambda x: x["content"] != "")
    has = F.exists(full, lambda x: x["role"] == "system")
    turn = lambda x: (F.when(x["role"] == "system", F.concat(F.lit(system), x["content"], F.lit("\n"))).when(x["role"] == "user", F.concat(F.lit(user[0]), x["content"], F.lit(user[1]))).when(x["role"] == "assistant", F.concat(F.lit(assistant), x["content"], F.lit(eos))).otherwise(F.raise_error(F.concat(F.lit("unsupported role "), x["role"]))))
    lead = F.when(has, F.lit("")).otherwise(F.lit(system + default_system + "\n" if default_system else ""))
    return F.concat(lead, _joined(F.transform(full, turn)), F.lit(assistant))


def _between(a: str, b: str) -> str:
    import re

    return "(?s)" + re.escape(a).replace("<", r"\x3c") + "(.*?)" + re.escape(b).replace("<", r"\x3c")


def parse_response(x: Column) -> Column:
    """A struct (content, reasoning, steps, conclusion, calls) of a response in the native format."""
    block_p, step_p, end_p, call_p, args_p = (_between(*p) for p in ((REASON, REASON_END), (STEP, STEP_END), (CONCLUDE, CONCLUDE_END), (CALL, CALL_END), (ARGS, ARGS_END)))
    has = F.regexp_like(x, F.lit(block_p))
    block = F.when(has, F.regexp_extract(x, block_p, 1))
    steps = F.transform(F.regexp_extract_all(block, F.lit(step_p), F.lit(1)), T.strip)
    conclusion = F.when(F.regexp_like(block, F.lit(end_p)), T.strip(F.regexp_extract(block, end_p, 1)))
    reasoning = F.nullif(T.strip(F.regexp_replace(F.regexp_replace(block, step_p, ""), end_p, "")), F.lit(""))
    bodies = F.transform(F.regexp_extract_all(x, F.lit(call_p), F.lit(1)), lambda c: T.strip(F.regexp_extract(c, args_p, 1)))
    calls = F.filter(bodies, lambda c: (c != "") & F.try_parse_json(c).isNotNull())
    content = T.strip(F.regexp_replace(F.regexp_replace(x, block_p, ""), call_p, ""))
    for mark in (ASSISTANT_END, TURN_END, END):
        content = F.when(F.endswith(content, F.lit(mark)), T.strip(F.substring(content, F.lit(1), F.length(content) - len(mark)))).otherwise(content)
    return F.struct(content.alias("content"), reasoning.alias("reasoning"), F.nullif(steps, F.array().cast("array<string>")).alias("steps"), conclusion.alias("conclusion"), F.nullif(calls, F.array().cast("array<string>")).alias("calls"))


def to_format(x: Column, style: str) -> Column:
    """Marks replaced one after the other, in their order."""
    for mark, other in CONVERSIONS[style]:
        x = F.replace(x, F.lit(mark), F.lit(other))
    return x


def from_format(x: Column, style: str) -> Column:
    """The inverse, which loses what two marks share: the first mark in order takes its text."""
    for mark, other in CONVERSIONS[style]:
        if other:
            x = F.replace(x, F.lit(other), F.lit(mark))
    return x


def last_assistant_record(rows: DataFrame) -> DataFrame:
    """(conv_id, prompt, completion): the messages before the last assistant turn, and its text."""
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kept = rows.withColumn("last", last).where("turn <= last")
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") < F.col("last"), F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))), lambda m: m["line"]), "\n")
    return kept.groupBy("conv_id").agg(prompt.alias("prompt"), F.max(F.when(F.col("turn") == F.col("last"), F.col("text"))).alias("completion"))


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "function": "tool", "observation": "tool", "prompter": "user"}


def normal_role(role: Column) -> Column:
    """Aliases of roles as the roles themselves, lower case."""
    low = F.lower(T.strip(role))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])[low], low)


def tolerant_json(x: Column) -> Column:
    """A JSON string that holds JSON is unwrapped; anything else is returned as it is."""
    return F.when(F.try_parse_json(x).isNotNull() & F.regexp_like(x, F.lit(r"^\s*[\[{\"]")), F.coalesce(F.to_json(F.try_parse_json(x)), x)).otherwise(x)


def choice_prompt(question: Column, choices: Column) -> Column:
    letters = F.array(*[F.lit(c) for c in "ABCDEFGH"])
    return F.concat(F.lit("Question: "), question, F.lit("\n"), F.array_join(F.transform(choices, lambda c, i: F.concat(F.get(letters, i), F.lit(". "), c)), "\n"), F.lit("\nAnswer:"))


def completion_window(prompt: Column, completion: Column, length: int) -> Column:
    """(start, kept): where the completion starts in a window of the last `length` tokens; a start below 1 is an error (null)."""
    total = prompt + completion
    start = prompt - F.greatest(total - length, F.lit(0))
    return F.struct(F.when(start >= 1, start).alias("start"), F.least(total, F.lit(length)).alias("kept"))


# ---- queries -------------------------------------------------------------------------------------------------------

_conv = lambda s, d: messages(read(s, d, "conversations"))
_M = "SELECT conv_id, {} FROM conversations GROUP BY conv_id"


def _agg(turn: str, where: str = "true", sep: str = "") -> str:
    return f"coalesce(string_agg({turn}, '{sep}' ORDER BY turn) FILTER ({where}), '')"


_NL = "chr(10)"
_SYS = "arg_min(text, turn) FILTER (role = 'system')"
_NATIVE = f"'{BEGIN}' || {_NL} || coalesce('{SYSTEM}' || {_NL} || {_SYS} || {_NL} || '{SYSTEM_END}' || {_NL}, '') || " + _agg(f"'{TURN}' || {_NL} || CASE role WHEN 'user' THEN '{USER}' || {_NL} || text || {_NL} || '{USER_END}' || {_NL} WHEN 'assistant' THEN '{ASSISTANT}' || {_NL} || text || {_NL} || '{ASSISTANT_END}' || {_NL} ELSE '' END || '{TURN_END}' || {_NL}", "role <> 'system'") + f" || '{TURN}' || {_NL} || '{ASSISTANT}' || {_NL}"
add("cht01_native_template", lambda s, d: _conv(s, d).select("conv_id", native_template(F.col("messages")).alias("prompt")), _M.format(f"{_NATIVE} AS prompt"))
add("cht02_chatml_template", lambda s, d: _conv(s, d).select("conv_id", chatml_template(F.col("messages")).alias("prompt")), _M.format(_agg(f"'{TURN}' || role || {_NL} || text || '{TURN_END}' || {_NL}") + f" || '{TURN}assistant' || {_NL} AS prompt"))
add("cht02_llama_template", lambda s, d: _conv(s, d).select("conv_id", llama_template(F.col("messages")).alias("prompt")), f"WITH f AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS fu, arg_min(text, turn) FILTER (role = 'system') OVER (PARTITION BY conv_id) AS sys FROM conversations) SELECT conv_id, '{BEGIN}' || " + _agg(f"CASE role WHEN 'user' THEN '[INST]' || CASE WHEN turn = fu AND coalesce(sys, '') <> '' THEN '{SYSTEM}' || {_NL} || sys || {_NL} || '{SYSTEM_END}' || {_NL} || {_NL} ELSE '' END || text || '[/INST]' WHEN 'assistant' THEN ' ' || text || ' {END}' ELSE '' END", "role <> 'system'") + " || ' ' AS prompt FROM f GROUP BY conv_id")
_COMPACT = {"native": "CASE WHEN role = 'system' THEN '<|system|>' || text ELSE '<|' || role || '|>' || text || '<|/' || role || '|>' END", "llama3": f"'<|start_header_id|>' || role || '<|end_header_id|>' || {_NL} || {_NL} || text || '<|eot_id|>'", "mistral": "CASE WHEN role = 'user' THEN '[INST]' || text || '[/INST]' ELSE text END", "chatml": f"'<|im_start|>' || role || {_NL} || text || '<|im_end|>'", "gemma": f"'<start_of_turn>' || CASE WHEN role = 'assistant' THEN 'model' ELSE 'user' END || {_NL} || text || '<end_of_turn>'", "plain": "role || ': ' || text"}
for _style, _sql in _COMPACT.items():
    add(f"cht03_{_style}", lambda s, d, style=_style: _conv(s, d).select("conv_id", compact_template(F.col("messages"), style).alias("prompt")), _M.format((f"string_agg({_sql}, chr(10) ORDER BY turn)" if _style == "chatml" else _agg(_sql)) + " AS prompt"))
add("cht04_sft_prompt", lambda s, d: _conv(s, d).select("conv_id", sft_prompt(F.col("messages"), "System: ", ("User: ", "\n"), "Assistant: ", "</s>", "Be brief.").alias("prompt")), _M.format(f"CASE WHEN count(*) FILTER (role = 'system' AND {D.strip('text')} <> '') > 0 THEN '' ELSE 'System: Be brief.' || {_NL} END || " + _agg(f"CASE role WHEN 'system' THEN 'System: ' || {D.strip('text')} || {_NL} WHEN 'user' THEN 'User: ' || {D.strip('text')} || {_NL} ELSE 'Assistant: ' || {D.strip('text')} || '</s>' END", f"{D.strip('text')} <> ''") + " || 'Assistant: ' AS prompt"))

_RESP = "'<|reason|><|step|> ' || substr(text, 1, 9) || '<|/step|><|step|>two<|/step|> why <|conclude|> so <|/conclude|><|/reason|> ' || substr(text, 10) || ' <|call|><|args|>{\"a\": 1}<|/args|><|/call|><|call|><|args|>broken<|/args|><|/call|><|/assistant|>'"


def _responses(s, d):
    t = F.col("text")
    return read(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("<|reason|><|step|> "), F.substring(t, 1, 9), F.lit("<|/step|><|step|>two<|/step|> why <|conclude|> so <|/conclude|><|/reason|> "), F.substring(t, F.lit(10), F.length(t)), F.lit(' <|call|><|args|>{"a": 1}<|/args|><|/call|><|call|><|args|>broken<|/args|><|/call|><|/assistant|>')).alias("x"))


add("cht05_parse_response", lambda s, d: _responses(s, d).select("conv_id", "turn", parse_response(F.col("x")).alias("p")).select("conv_id", "turn", "p.content", "p.reasoning", F.array_join("p.steps", "|").alias("steps"), "p.conclusion", F.array_join("p.calls", "|").alias("calls")), f"""SELECT conv_id, turn, {D.strip('substr(text, 10)')} AS content, 'why' AS reasoning, {D.strip('substr(text, 1, 9)')} || '|two' AS steps, 'so' AS conclusion, '{{"a": 1}}' AS calls FROM conversations WHERE role = 'assistant'""")


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


for _style in ("llama3", "mistral", "chatml", "gemma", "qwen"):
    _x = "'<|begin|><|user|>' || text || '<|/user|><|reason|>r<|/reason|><|assistant|>a<|/assistant|><|call|>x<|end|>'"
    _col = lambda: F.concat(F.lit("<|begin|><|user|>"), F.col("text"), F.lit("<|/user|><|reason|>r<|/reason|><|assistant|>a<|/assistant|><|call|>x<|end|>"))
    add(f"cht06_to_{_style}", lambda s, d, style=_style, col=_col: read(s, d, "benchmark").select("item_id", to_format(col(), style).alias("text")), f"SELECT item_id, {_replaced(_x, CONVERSIONS[_style])} AS text FROM benchmark")
    add(f"cht06_from_{_style}", lambda s, d, style=_style, col=_col: read(s, d, "benchmark").select("item_id", from_format(to_format(col(), style), style).alias("text")), f"SELECT item_id, {_replaced(_replaced(_x, CONVERSIONS[_style]), [(b, a) for a, b in CONVERSIONS[_style] if b])} AS text FROM benchmark")
add("cht07_last_assistant", lambda s, d: last_assistant_record(read(s, d, "conversations")), f"WITH l AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, {_agg("role || ': ' || text", 'turn < last', chr(10))} AS prompt, max(text) FILTER (turn = last) AS completion FROM l WHERE turn <= last GROUP BY conv_id")
add("cht08_normal_roles", lambda s, d: read(s, d, "conversations").select("conv_id", "turn", normal_role(F.when(F.pmod("turn", F.lit(3)) == 0, " Human ").when(F.pmod("turn", F.lit(3)) == 1, "GPT").otherwise(F.upper("role"))).alias("role")), "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE role END AS role FROM conversations")
add("cht09_tool_call_tags", lambda s, d: read(s, d, "events").select("event_id", F.concat(F.lit("<tool_call>"), F.to_json(F.struct(F.col("event_type").alias("name"), F.struct(F.col("user_id").alias("value")).alias("arguments"))), F.lit("</tool_call>")).alias("tag")), """SELECT event_id, '<tool_call>{"name":"' || event_type || '","arguments":{"value":' || CAST(user_id AS VARCHAR) || '}}</tool_call>' AS tag FROM events""")
both("cht10_record_adapter", "SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, CASE WHEN doc_id % 3 = 0 THEN source END, '') AS prompt, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, source) AS completion FROM {documents}")
both("cht11_flatten_dialogue", "SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS completion FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND length(b.text) >= 20")
both("cht12_wrap_helpers", "SELECT item_id, '<|code|>' || text || '<|/code|>' AS code, '<|memory|>' || substr(text, 1, 20) || '<|/memory|>' AS memory FROM {benchmark}")
add("cht14_choice_prompt", lambda s, d: read(s, d, "benchmark").select("item_id", choice_prompt(F.substring("text", 1, 30), F.slice(T.split_words(F.col("text")), 1, 4)).alias("prompt")), f"SELECT item_id, 'Question: ' || substr(text, 1, 30) || {_NL} || array_to_string([substr('ABCD', i, 1) || '. ' || w[i] FOR i IN range(1, least(len(w), 4) + 1)], {_NL}) || {_NL} || 'Answer:' AS prompt FROM (SELECT item_id, text, {D.split('text')} AS w FROM benchmark)")
add("cht15_choice_windows", lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", completion_window(F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long") * 9, 48).alias("w")).select("l_orderkey", "l_linenumber", "w.start", "w.kept"), "SELECT l_orderkey, l_linenumber, CASE WHEN p - greatest(p + c - 48, 0) >= 1 THEN p - greatest(p + c - 48, 0) END AS start, least(p + c, 48) AS kept FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS p, CAST(l_linenumber AS BIGINT) * 9 AS c FROM lineitem)")
add("jsn01_event_props", lambda s, d: read(s, d, "events").select("event_id", tolerant_json(F.when(F.pmod("event_id", F.lit(2)) == 0, F.lit('{"a": [1, 2]}')).otherwise(F.lit("not json"))).alias("value")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"a\":[1,2]}' ELSE 'not json' END AS value FROM events")

# ---- supervised encoding on token arrays ---------------------------------------------------------------------------


def encode_example(prompt: Column, completion: Column, length: int, room: int = 8, ignore: int = -100) -> Column:
    """(ids, labels): the prompt cut from the left, the completion from the right, at least `room` left for it; prompt masked."""
    spared = F.lit(length) - F.least(F.size(completion), F.lit(room))  # what the prompt may take if both are too long
    kept_p = F.least(F.size(prompt), F.greatest(F.lit(length) - F.size(completion), spared))
    p = F.when(kept_p > 0, F.slice(prompt, F.greatest(F.size(prompt) - kept_p + 1, F.lit(1)), kept_p)).otherwise(F.slice(prompt, 1, 0))
    c = F.slice(completion, F.lit(1), F.greatest(F.lit(length) - kept_p, F.lit(0)))
    return F.struct(F.concat(p, c).alias("ids"), F.concat(F.transform(p, lambda _: F.lit(str(ignore))), c).alias("labels"))


add(
    "pck08_sft_encode",
    lambda s, d: read(s, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", encode_example(T.split_words(F.col("text")), F.slice(T.split_words(F.col("text")), 1, 30), 48, 8, -100).alias("e")).select("conv_id", "turn", F.size("e.ids").cast("long").alias("n"), F.size(F.filter("e.labels", lambda x: x != "-100")).cast("long").alias("supervised")),
    f"SELECT conv_id, turn, least(n, greatest(48 - least(n, 30), 48 - least(n, 30, 8))) + least(least(n, 30), 48 - least(n, greatest(48 - least(n, 30), 48 - least(n, 30, 8)))) AS n, least(least(n, 30), 48 - least(n, greatest(48 - least(n, 30), 48 - least(n, 30, 8)))) AS supervised FROM (SELECT conv_id, turn, len({D.split('text')}) AS n FROM conversations WHERE role = 'assistant')",
)

QUERIES, ORACLES = BOOK.queries, BOOK.oracles
