"""Structured fields of raw synopses (T1): an Arrow UDF, since what a line means depends on the lines before it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K

_SEP = re.compile(K.TAG_SEPARATORS)
_LABEL = r"[：:]\s*"
_INTROS = "|".join(K.INTRO_NAMES)
#: What is taken off the front of a prose line, in this order.
_FRONTS = [re.compile(p) for p in (K.HEADER_PREFIX, rf"^(?:{_INTROS})(?:{_LABEL}|[\s　\xa0]+)", rf"^[\s　\xa0]*【(?:{_INTROS})】[\s　\xa0]*")]
_FIELD = re.compile(rf"^\s*({K.TAGS_NAME}|{K.KEYWORDS_NAME}|{K.ONE_LINER_NAME}|{K.INTENT_NAME}){_LABEL}(.+)$")
_TOPIC = re.compile(rf"^\s*{K.TOPIC_NAME}{_LABEL}(.*)$")
_STOP, _RULE, _OTHER, _BRACKET = (re.compile(p) for p in (K.STOP_LINE, K.RULE_LINE, K.KEYWORD_OTHER, K.TITLE_BRACKET))


def split_tags(text: str) -> list[str]:
    return [t for t in _SEP.split(text.strip()) if t and len(t) <= K.TAG_CHARS and t not in K.NOT_TAGS]


def extract(raw: str, title: str = "", author: str = "") -> dict:
    tags, prose, fields, topics = [], [], {K.ONE_LINER_NAME: "", K.INTENT_NAME: ""}, False
    for line in map(str.strip, (raw or "").splitlines()):
        if line and _STOP.search(line):
            break
        topic, field = _TOPIC.match(line), _FIELD.match(line)
        if topic or topics and line:
            topics = True
            tags += split_tags(topic[1] if topic else line)
        elif not line:
            prose += [] if topics else [""]
        elif field and field[1] == K.TAGS_NAME:
            tags += split_tags(field[2])
        elif field and field[1] == K.KEYWORDS_NAME:
            tags += [t for part in _OTHER.findall(field[2]) for t in split_tags(part)]
        elif field:
            fields[field[1]] = field[2].strip()
        elif line not in K.NOISE_LINES and not _RULE.match(line):
            for front in _FRONTS:
                line = front.sub("", line)
            prose += [line.strip()] if line.strip() else []
    tags += [m for x in _BRACKET.findall(title or "") if (m := x.strip()) and m not in K.NOT_TAGS]
    kept = dict.fromkeys(t for t in tags if t != (author or "").strip() and t not in (title or ""))
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(prose)).strip()
    return {"tags": list(kept), "one_liner": fields[K.ONE_LINER_NAME], "intent": fields[K.INTENT_NAME], "synopsis": text}


_TYPE = T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), *[T.StructField(c, T.StringType()) for c in ("one_liner", "intent", "synopsis")]])


@F.pandas_udf(_TYPE)
def extract_tags(raw: pd.Series, title: pd.Series, author: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(r, t or "", a or "") for r, t, a in zip(raw, title, author, strict=True)], columns=["tags", "one_liner", "intent", "synopsis"])
