"""Record classification and conversation envelopes.

A record is a user turn, an assistant ("claude") turn or a note.  Envelopes are JSON objects
inside ``text``; they are parsed once per row into a VARIANT and only JSON *string* values
count (numbers/objects at the same key are ignored, as in the reference).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NO_PROMPT

# Fixed values of the envelope format.
USER_EVENT = "UserPromptSubmit"
ASSISTANT_EVENT = "Stop"
RESPONSE_TAG = "response"
PROMPT_TAG = "prompt"
_END = "end_of_text"
JSON_SPACE = " \t\n\r"
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}  # Spark takes both by default
ROLE_USER, ROLE_CLAUDE, ROLE_NOTE = "user", "claude", "note"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def envelope_fields(text: Column) -> Column:
    """The envelope's fields of a text that is one JSON object and nothing else, as a struct of
    VARIANTs; NULL otherwise.  The parser stops at the end of the first value, so the text is parsed
    as the first of two array items; the second, which names the text's hash, shows that
    nothing stood between.  Only texts that start with ``{`` are parsed, once each."""
    mark = F.xxhash64(text).cast("string")
    wrapped = F.concat(F.lit("["), text, F.lit(',{"' + _END + '":"'), mark, F.lit('"}]'))
    starts = F.ltrim(text, F.lit(JSON_SPACE)).startswith("{")
    fields = ", ".join(f"{k}: variant" for k in ("hook_event_name", "session_id", "prompt", "response"))
    items = F.from_json(F.when(starts, wrapped), f"array<struct<{fields}, {_END}: string>>", STRICT_JSON)
    return F.when((F.size(items) == 2) & (items[1][_END] == mark), items[0])


def json_string(v: Column, field: str) -> Column:
    """The JSON string in ``field``; NULL when missing or of another JSON type."""
    return F.when(F.schema_of_variant(v[field]) == "STRING", F.try_variant_get(v[field], "$", "string"))


def classify(text: Column | str = "text", tags: Column | str = "tags") -> Column:
    """C1 (server/CLI rule) -> STRUCT<role, body, session_id>.

    * tag ``response``: ``Stop`` envelope -> claude, body = ``response`` string or '',
      session = ``session_id`` string; otherwise claude with the raw text, no session.
    * else ``UserPromptSubmit`` envelope -> user, body = ``prompt`` string or '<no prompt>'.
    * else note with the raw text.
    Text after the JSON value makes the record a note; of repeated keys the last counts.
    """
    t, g = _c(text), _c(tags)
    v = envelope_fields(t)
    hook = json_string(v, "hook_event_name")
    sid = json_string(v, "session_id")
    has_resp = F.array_contains(g, RESPONSE_TAG)
    is_stop = has_resp & F.coalesce(hook == ASSISTANT_EVENT, F.lit(False))
    is_user = ~has_resp & F.coalesce(hook == USER_EVENT, F.lit(False))
    role = F.when(has_resp, ROLE_CLAUDE).when(is_user, ROLE_USER).otherwise(ROLE_NOTE)
    body = (
        F.when(is_stop, F.coalesce(json_string(v, "response"), F.lit("")))
        .when(has_resp, t)
        .when(is_user, F.coalesce(json_string(v, "prompt"), F.lit(NO_PROMPT)))
        .otherwise(t)
    )
    session = F.when(is_stop | is_user, sid)
    return F.struct(role.alias("role"), body.alias("body"), session.alias("session_id"))


def classify_lenient(text: Column | str = "text", tags: Column | str = "tags") -> Column:
    """C2 (the UI rule): the envelope decides first, then the tag.  An empty body falls back to
    the raw text.  Records that are neither get role NULL."""
    t, g = _c(text), _c(tags)
    v = envelope_fields(t)
    hook, sid, prompt, resp = (json_string(v, k) for k in ("hook_event_name", "session_id", "prompt", "response"))
    is_user = F.coalesce(hook == USER_EVENT, F.lit(False))
    is_stop = F.coalesce(hook == ASSISTANT_EVENT, F.lit(False))
    has_resp = F.array_contains(g, RESPONSE_TAG)
    role = F.when(is_user, ROLE_USER).when(is_stop | has_resp, ROLE_CLAUDE)
    nonempty = lambda c: F.when(F.length(c) > 0, c)  # noqa: E731  (JS truthiness for strings)
    body = (
        F.when(is_user, F.coalesce(nonempty(prompt), t))
        .when(is_stop, F.coalesce(nonempty(resp), t))
        .when(has_resp, t)
    )
    session = F.when(is_user | is_stop, sid)
    return F.struct(role.alias("role"), body.alias("body"), session.alias("session_id"))


def envelope(event: str, body: Column, session_id: Column, cwd: Column | None = None) -> Column:
    """C14: ``{"hook_event_name", "prompt"|"response", "session_id"[, "cwd"]}`` as compact JSON.
    NULL fields are left out; non-ASCII stays as is."""
    key = "prompt" if event == USER_EVENT else "response"
    fields = [F.lit(event).alias("hook_event_name"), body.alias(key), session_id.alias("session_id")]
    if cwd is not None:
        fields.append(cwd.alias("cwd"))
    return F.to_json(F.struct(*fields))
