"""Structured extraction from transcripts and specifications through an injectable model client."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamdex.functions.text import detect_extract_type

SCHEMA_VERSION, RETRIES = "1.0", 3
RESULT = (
    "struct<segments:array<struct<topic:string,summary:string,action_items:array<struct<task:string>>,contains_decision:boolean>>,"
    "sections:array<struct<title:string,content:string>>>"
)

#: (kind, text) -> JSON of the result
Client = Callable[[str, str], str]


def rule_client(kind: str, text: str) -> str:
    """A deterministic stand-in for a model: speakers' turns are segments, headings sections."""
    if kind == "spec":
        parts = re.split(r"(?m)^#{1,6}\s+(.*)$", text)
        return json.dumps({"segments": [], "sections": [{"title": t.strip(), "content": c.strip()} for t, c in zip(parts[1::2], parts[2::2], strict=True)]}, ensure_ascii=False)
    turns = [m for m in re.findall(r"(?m)^([^:\n\d][^:\n]{0,39}):\s*(.+)$", text)]
    made = [{"topic": who, "summary": said[:200], "action_items": [], "contains_decision": bool(re.search(r"(?i)decid|결정", said))} for who, said in turns]
    return json.dumps({"segments": made, "sections": []}, ensure_ascii=False)


def http_client(url: str, model: str, timeout: float = 600) -> Client:
    """A client of a local model server that answers with JSON."""

    def ask(kind: str, text: str) -> str:
        import urllib.request

        body = json.dumps({"model": model, "prompt": f"Extract the {kind} as JSON.\n\n{text}", "stream": False, "format": "json", "options": {"temperature": 0}}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{url}/api/generate", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.loads(answer.read())["response"]

    return ask


def extract(docs: DataFrame, client: Client = rule_client, body: str = "body") -> DataFrame:
    """(doc_id, kind, result, error, chars): unknown kinds are read as meetings; a client that fails is asked again."""

    @F.pandas_udf(StringType())
    def ask(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for kind, text in zip(kinds, texts.fillna(""), strict=True):
            answer = None
            for attempt in range(RETRIES):
                try:
                    answer = client(kind, text)
                    json.loads(answer)
                    break
                except Exception as e:  # noqa: BLE001  a client may fail in any way, and that is a result
                    answer = json.dumps({"error": str(e)[:500]})
                    time.sleep(0.01 * attempt)
            out.append(answer)
        return pd.Series(out)

    kind = detect_extract_type(F.col(body))
    rows = docs.withColumn("kind", F.when(kind == "unknown", "meeting").otherwise(kind)).withColumn("answer", ask(F.col("kind"), F.col(body)))
    return rows.select("doc_id", "kind", F.from_json("answer", RESULT).alias("result"), F.get_json_object("answer", "$.error").alias("error"), F.length(body).alias("chars"))
