"""Chat formatting: whole conversations rendered once, encoded once, with a loss mask aligned by offsets."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template. A turn is OPEN role MIDDLE text CLOSE; the escape character stands for itself doubled by a mark.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|over|>"
# Control strings of common chat templates, which must not stand in a text as they are.
CONTROLS = (OPEN, MIDDLE, CLOSE, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
MARK = "⁠"  # word joiner


def escape(text: str) -> str:
    """Put MARK behind the first character of each control string; a MARK of the text itself is doubled."""
    text = text.replace(MARK, MARK + MARK)
    for c in CONTROLS:
        text = text.replace(c, c[0] + MARK + c[1:])
    return text


def unescape(text: str) -> str:
    out, i, n = [], 0, len(text)
    while (at := text.find(MARK, i)) >= 0:
        out.append(text[i:at])
        if text.startswith(MARK, at + 1):
            out.append(MARK)
            at += 1
        i = at + 1
        if i >= n:
            break
    out.append(text[i:])
    return "".join(out)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (code points, end exclusive) of its escaped assistant texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + MIDDLE, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        turns.append((unescape(role), unescape(rest[: rest.rindex(CLOSE)])))
    return turns


def loss_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(token, start, end) for each token that meets a turn span, clipped to it; both lists are sorted by start.

    For each span a binary search finds the first token that ends behind its start; tokens that share a character
    (parts of one code point) repeat its offsets.
    """
    ends = [b for _, b in offsets]
    out = []
    for start, end in spans:
        k = bisect.bisect_right(ends, start)
        while k < len(offsets) and offsets[k][0] < end:
            a, b = max(offsets[k][0], start), min(offsets[k][1], end)
            if a < b:
                out.append((k, a, b))
            k += 1
    return out


def masked_texts(formatted: str, mask: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[str]:
    """The characters under the mask, each once, per span, unescaped."""
    texts, k = [], 0
    for start, end in spans:
        done, parts = start, []
        while k < len(mask) and mask[k][1] < end:
            _, a, b = mask[k]
            if b > done:
                parts.append(formatted[max(a, done) : b])
                done = b
            k += 1
        texts.append(unescape("".join(parts)))
    return texts


def _tokenizer(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    return t


def format_conversations(rows: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """Per conversation: digests read back from its formatted text, and the number of tokens under the loss mask.

    Rows go to their conversation's partition, sorted by turn (then role and text, so that ties and repeated rows have
    one order; a null turn comes first), and stream through; only one conversation is held at a time. A null role or
    text is empty. A null conv_id is one conversation. Other columns are ignored. ``with_text`` adds formatted (the
    text itself), token_ids and loss_tokens (places of the masked tokens).
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, n_loss_tokens bigint"
    if with_text:
        schema += ", formatted string, token_ids array<int>, loss_tokens array<int>"

    def one(key, turns, tokenizer):
        formatted, spans = render(turns)
        encoded = tokenizer.encode(formatted, add_special_tokens=False)
        mask = loss_mask(encoded.offsets, spans)
        back = parse(formatted)
        loss = "".join(masked_texts(formatted, mask, spans))
        whole = "".join(f"{r}\n{t}\n" for r, t in back)
        row = [key, len(back), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted), len(encoded.ids), len({k for k, _, _ in mask})]
        return row + [formatted, encoded.ids, sorted({k for k, _, _ in mask})] if with_text else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        key, turns, out, begun = None, [], [], False
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split(" ")[0] for c in schema.split(", ")]
        if with_text:
            types += [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for k, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if begun and k != key:
                    out.append(one(key, turns, tokenizer))
                    turns = []
                    if len(out) >= 512:
                        yield batch_of(out)
                        out = []
                key, begun = k, True
                turns.append((role or "", text or ""))
        if begun:
            out.append(one(key, turns, tokenizer))
        if out:
            yield batch_of(out)

    wanted = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)
