"""Prompt, payload and answer tables of offline triage. Nothing here talks to a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logmill.functions.records import strict_json
from logmill.functions.text import let, mask_literals, text_lines, token_estimate, trim_space

# Prompt wording, and the section prefixes of an answer.
INSTRUCTION = "Find the root cause without inventing errors."
SYNTHESIS = (
    "Combine these batch findings. If no failure exists, say so. "
    "Follow CAUSE/FIX/VERIFY format.\n\n"
)
SECTIONS = (("cause", "CAUSE:"), ("fix", "FIX:"), ("verify", "VERIFY:"))
TRANSIENT_STATUS = (429, 502, 503, 504)
PROTOCOLS = ("responses", "chat", "local", "generate_content", "messages")


def map_prompts(prepared: DataFrame, instruction: str = INSTRUCTION, key: str = "doc_id") -> DataFrame:
    """One prompt per batch; several batches are numbered."""
    total = F.size("batches")
    body = F.concat(F.lit(instruction.strip() or INSTRUCTION), F.lit("\n\n"), F.col("batch"))
    header = F.concat(
        F.lit("Log batch "), F.col("batch_index") + 1, F.lit("/"), F.col("batch_total"), F.lit(":\n\n")
    )
    rows = prepared.select(
        key, total.alias("batch_total"), F.posexplode("batches").alias("batch_index", "batch")
    )
    return rows.select(
        key, "batch_index", "batch_total",
        F.when(F.col("batch_total") > 1, F.concat(header, body)).otherwise(body).alias("prompt"),
    )


def announcement(prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    """The message that opens the analysis of a prepared file."""
    text = F.concat(
        F.lit("Analyze "), F.col("name"), F.lit(": "), F.col("event_count"), F.lit(" events, "),
        F.col("duplicate_count"), F.lit(" duplicates removed, "), F.size("batches"),
        F.lit(" batches."),
    )
    return prepared.select(key, text.alias("message"))


def synthesis_prompts(
    findings: DataFrame, key: str = "doc_id", order: str = "batch_index", text: str = "finding"
) -> DataFrame:
    """One reduce prompt per document. Findings per document are bounded by its batch count."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    joined = F.array_join(F.transform(ordered, lambda x: x[text]), "\n\n")
    return findings.groupBy(key).agg(F.concat(F.lit(SYNTHESIS), joined).alias("prompt"))


def max_cost(chars: Column, max_output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Upper cost of a request in the price unit per million tokens; NULL without prices."""
    cost = (
        token_estimate(chars) * input_price / F.lit(1_000_000.0)
        + max_output_tokens * output_price / F.lit(1_000_000.0)
    )
    return F.when((input_price > 0) | (output_price > 0), cost)


def usage_line(
    input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column,
    tokens_per_second: Column | None = None, first_token_seconds: Column | None = None,
) -> Column:
    """Usage summary with actual cost, speed and time to first token where known."""
    cost = (
        input_tokens * input_price / F.lit(1_000_000.0)
        + output_tokens * output_price / F.lit(1_000_000.0)
    )
    priced = (input_price > 0) | (output_price > 0)
    known = input_tokens.isNotNull() & output_tokens.isNotNull() & priced
    parts = [
        F.lit("Request "), F.coalesce(input_tokens.cast("string"), F.lit("?")),
        F.lit(" tokens · Response "), F.coalesce(output_tokens.cast("string"), F.lit("?")),
        F.lit(" tokens"),
        F.when(known, F.format_string(" · ≈$%.4f", cost)).otherwise(""),
    ]
    if tokens_per_second is not None:
        parts.append(
            F.coalesce(F.when(tokens_per_second.isNotNull(), F.format_string(" · %.1f tok/s", tokens_per_second)), F.lit(""))
        )
    if first_token_seconds is not None:
        parts.append(
            F.coalesce(F.when(first_token_seconds.isNotNull(), F.format_string(" · TTFT %.2fs", first_token_seconds)), F.lit(""))
        )
    return F.concat(*parts)


def sections(text: Column) -> Column:
    """``struct<cause, fix, verify>`` of an answer; the last line of each kind wins and the whole
    text is the cause when none is marked."""

    def last_marked(lines: Column, prefix: str) -> Column:
        marked = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(prefix)))
        value = let(marked, lambda m: F.get(m, F.size(m) - 1))
        return F.coalesce(trim_space(F.substr(value, F.lit(len(prefix) + 1))), F.lit(""))

    def build(lines: Column) -> Column:
        found = {name: last_marked(lines, prefix) for name, prefix in SECTIONS}
        cause = F.coalesce(F.nullif(found["cause"], F.lit("")), trim_space(text))
        return F.struct(
            cause.alias("cause"), found["fix"].alias("fix"), found["verify"].alias("verify")
        )

    return let(F.transform(text_lines(text), trim_space), build)


def extract_json(text: Column) -> Column:
    """``struct<json, error>``: first ``{`` to last ``}`` of an answer."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    has_end = F.instr(text, "}") > 0
    error = (
        F.when(start == 0, "provider returned no JSON object")
        .when(~has_end, "provider returned incomplete JSON")
        .when(start >= end, "provider returned invalid JSON bounds")
    )
    body = F.when(error.isNull(), F.substring(text, start, end - start + 1))
    return F.struct(body.alias("json"), error.alias("error"))


def payload(
    protocol: str, model: Column, system: Column, role: Column, content: Column, max_tokens: Column
) -> Column:
    """JSON request body of one message in one of the request shapes."""
    def one(**fields: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    assistant = role == "assistant"
    if protocol == "responses":
        item = one(role=role, content=F.array(one(type=F.lit("input_text"), text=content)))
        effort = F.when(F.startswith(model, F.lit("gpt-5")), one(effort=F.lit("low")))
        body = one(model=model, instructions=system, input=F.array(item),
                   max_output_tokens=max_tokens, store=F.lit(False), reasoning=effort)
    elif protocol == "chat":
        first = one(role=F.lit("system"), content=system)
        body = one(model=model, messages=F.array(first, one(role=role, content=content)),
                   max_tokens=max_tokens)
    elif protocol == "local":
        body = one(model=model, input=content, system_prompt=system,
                   max_output_tokens=max_tokens, store=F.lit(False))
    elif protocol == "generate_content":
        item = one(role=F.when(assistant, "model").otherwise("user"),
                   parts=F.array(one(text=content)))
        body = one(systemInstruction=one(parts=F.array(one(text=system))),
                   contents=F.array(item), generationConfig=one(maxOutputTokens=max_tokens))
    elif protocol == "messages":
        item = one(role=F.when(assistant, "assistant").otherwise("user"),
                   content=F.array(one(type=F.lit("text"), text=content)))
        body = one(model=model, system=system, messages=F.array(item), max_tokens=max_tokens)
    else:
        raise ValueError(f"unknown protocol: {protocol}")
    return F.to_json(body)


def _whole_number(value: Column, *paths: str) -> Column:
    texts = [F.try_variant_get(value, p, "string") for p in paths]
    numbers = [F.when(t.rlike("^[0-9]{1,18}$"), t.try_cast("bigint")) for t in texts]
    return F.coalesce(*numbers)


def _items(value: Column, path: str) -> Column:
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")
    )


def _first_text(items: Column, path: str) -> Column:
    texts = F.transform(items, lambda x: F.try_variant_get(x, path, "string"))
    return F.get(F.array_compact(texts), F.lit(0))


def answer(protocol: Column, body: Column) -> Column:
    """``struct<text, input_tokens, output_tokens, error>`` of a stored response body, by its shape."""

    def build(v: Column) -> Column:
        outputs = F.transform(_items(v, "$.output"), lambda o: _first_text(_items(o, "$.content"), "$.text"))
        local = F.filter(
            _items(v, "$.output"), lambda o: F.try_variant_get(o, "$.type", "string") == "message"
        )
        text = (
            F.when(
                protocol == "responses",
                F.coalesce(
                    F.try_variant_get(v, "$.output_text", "string"),
                    F.get(F.array_compact(outputs), F.lit(0)),
                ),
            )
            .when(protocol == "chat", F.try_variant_get(v, "$.choices[0].message.content", "string"))
            .when(
                protocol == "generate_content",
                F.try_variant_get(v, "$.candidates[0].content.parts[0].text", "string"),
            )
            .when(protocol == "local", trim_space(_first_text(local, "$.content")))
            .when(protocol == "messages", _first_text(_items(v, "$.content"), "$.text"))
        )
        both = protocol.isin("responses", "chat")

        def tokens(meta: str, stats: str, usage: str, other: str) -> Column:
            return (
                F.when(protocol == "generate_content", _whole_number(v, meta))
                .when(protocol == "local", _whole_number(v, stats))
                .otherwise(
                    F.coalesce(_whole_number(v, usage), F.when(both, _whole_number(v, other)))
                )
            )

        tokens_in = tokens("$.usageMetadata.promptTokenCount", "$.stats.input_tokens",
                           "$.usage.input_tokens", "$.usage.prompt_tokens")
        tokens_out = tokens("$.usageMetadata.candidatesTokenCount", "$.stats.total_output_tokens",
                            "$.usage.output_tokens", "$.usage.completion_tokens")
        return F.struct(
            text.alias("text"),
            tokens_in.alias("input_tokens"),
            tokens_out.alias("output_tokens"),
            F.when(text.isNull(), "response contained no text").alias("error"),
        )

    return let(strict_json(body), build)


def response_outcome(status: Column) -> Column:
    return (
        F.when(status.between(200, 299), "ok")
        .when(status.isin(*TRANSIENT_STATUS), "transient")
        .otherwise("final")
    )


def api_error(status: Column, body: Column, secrets: list[str]) -> Column:
    """Error text with known secrets masked, 500 characters at most."""
    message = F.coalesce(F.try_variant_get(strict_json(body), "$.error.message", "string"), body)
    return F.concat(F.lit("HTTP "), status, F.lit(": "), mask_literals(message, secrets, limit=500))


def model_names(listings: DataFrame, provider: str = "provider", body: str = "body") -> DataFrame:
    """Distinct, sorted generative model names of stored model listings."""
    v = strict_json(F.col(body))
    gemini = F.transform(
        F.filter(
            _items(v, "$.models"),
            lambda m: F.array_contains(
                F.transform(
                    _items(m, "$.supportedGenerationMethods"),
                    lambda x: F.try_variant_get(x, "$", "string"),
                ),
                "generateContent",
            ),
        ),
        lambda m: F.regexp_replace(F.try_variant_get(m, "$.name", "string"), "^(?:models/)+", ""),
    )
    local = F.transform(
        F.filter(_items(v, "$.models"), lambda m: F.try_variant_get(m, "$.type", "string") == "llm"),
        lambda m: F.try_variant_get(m, "$.key", "string"),
    )
    listed = F.transform(_items(v, "$.data"), lambda m: F.try_variant_get(m, "$.id", "string"))
    names = (
        F.when(F.col(provider) == "generate_content", gemini)
        .when(F.col(provider) == "local", local)
        .otherwise(listed)
    )
    return (
        listings.select(provider, F.explode(F.array_compact(names)).alias("model"))
        .distinct()
        .orderBy(provider, "model")
    )
