"""Token counts of chats under a template, by a vocabulary file that the caller names."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands around a turn, before a reply, and for a reply that must not think.
TURN, REPLY, NO_THINKING = ("<|im_start|>{role}\n", "{content}<|im_end|>\n"), "<|im_start|>assistant\n", "<think>\n\n</think>\n\n"


#: Characters of texts that are encoded at once: an encoding takes hundreds of bytes a token.
LOT = 1 << 18


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def template_text(messages: Column, reply: bool = True, thinking: bool = True) -> Column:
    """A chat as one text, with the start of the next reply where one is asked for."""
    head, tail = TURN
    turn = lambda m: F.concat(F.replace(F.lit(head), F.lit("{role}"), F.coalesce(m["role"], F.lit(""))), F.coalesce(m["content"], F.lit("")), F.lit(tail.removeprefix("{content}")))
    told = F.array_join(F.transform(messages, turn), "")
    return F.concat(told, F.lit((REPLY + ("" if thinking else NO_THINKING)) if reply else ""))


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of a text, without begin, end or padding, whole; null is null."""

    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        out: list[int | None] = [None] * len(texts)
        rows, lot, size = [], [], 0
        for i, x in enumerate(texts):
            if x.is_valid:
                rows.append(i)
                lot.append(x.as_py())
                size += len(lot[-1])
            if lot and (size >= LOT or i == len(texts) - 1):
                for row, e in zip(rows, tokenizer(vocabulary).encode_batch(lot, add_special_tokens=False), strict=True):
                    out[row] = len(e)
                rows, lot, size = [], [], 0
        return pa.array(out, pa.int64())

    return run(text)


def prompt_tokens(messages: Column, vocabulary: str, thinking: bool = True) -> Column:
    return token_count(template_text(messages, True, thinking), vocabulary)
