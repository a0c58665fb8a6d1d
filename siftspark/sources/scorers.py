"""Rerankers as scorers: a cross-encoder in the process, or a model behind an HTTP service.

A scorer maps a query and documents to one number each and raises where it cannot; ``operators.fusion.rerank`` keeps the
order as it was then. None of these libraries or services is needed to run a query.
"""

from __future__ import annotations

import json
import math
import re
import urllib.error
from collections.abc import Callable, Sequence

from ..functions.scores import ScoreError, checked_scores, yes_no_from_logprobs
from ..functions.text import RERANK_INSTRUCTION
from .services import Scorer, ServiceError, post_json

# Models, and how a yes-or-no reranker is told its task.
ENCODER_MODELS = ("Qwen/Qwen3-Reranker-0.6B", "tomaarsen/Qwen3-Reranker-0.6B-seq-cls")
SERVICE_MODEL = "qwen3-reranker:0.6b"
MAX_LENGTH, TIMEOUT = 512, 20
SYSTEM = (
    "Judge whether the Document meets the requirements based on the Query "
    'and the Instruct provided. Note that the answer can only be "yes" or "no".'
)
BACKENDS = ("crossencoder", "ollama", "off")


def pair_prompt(query: str, document: str, instruction: str = RERANK_INSTRUCTION) -> str:
    """``functions.text.rerank_pair`` of one query and document."""
    return f"<Instruct>: {instruction}\n<Query>: {query or ''}\n<Document>: {document or ''}"


def generate_prompt(query: str, document: str, instruction: str = RERANK_INSTRUCTION) -> str:
    """The pair in the chat template of the model, with an empty thought, so that its next token is the answer."""
    turn = lambda role, text: f"<|im_start|>{role}\n{text}"
    asked = turn("system", SYSTEM) + "<|im_end|>\n" + turn("user", pair_prompt(query, document, instruction)) + "<|im_end|>\n"
    return asked + turn("assistant", "<think>\n\n</think>\n\n")


def said_score(text: str) -> float:
    """The text form of ``functions.scores.parse_score``: an answer that is no score is an error."""
    plain = re.sub(r"(?is)<think>.*?</think>", "", text or "").strip()
    number = r"[-+]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][-+]?\d+)?"
    if re.search(rf"{number}\s*,\s*{number}", plain):
        raise ScoreError("the reranker answered with a list of numbers")
    word = re.search(r"\b(yes|no)\b", plain, re.I)
    if word:
        return float(word[1].lower() == "yes")
    found = re.search(number, plain)
    if not found:
        raise ScoreError("the reranker answered neither yes nor no nor a number")
    x = float(found[0])
    return 0.0 if x < 0 else x if x <= 1 else x / 100 if x <= 100 else 1 / (1 + math.exp(-x))


def answered_score(answer: dict) -> float:
    """From the log probabilities of yes and no where the answer has them, else from its text."""
    message = answer.get("message") if isinstance(answer.get("message"), dict) else {}
    tokens: list = []
    for part in (answer, message):
        for name in ("logprobs", "probs"):
            held = part.get(name)
            if isinstance(held, dict):
                held = next((held[k] for k in ("content", "tokens", "top_logprobs") if held.get(k)), None)
            tokens += [t for t in held if isinstance(t, dict)] if isinstance(held, list) else []
    score = yes_no_from_logprobs(tokens)
    if score is not None:
        return score
    text = answer.get("response") if isinstance(answer.get("response"), str) else message.get("content")
    return said_score(text if isinstance(text, str) else "")


def service_scorer(base: str, model: str = SERVICE_MODEL, *, instruction: str = RERANK_INSTRUCTION, timeout: float = TIMEOUT, post=post_json) -> Scorer:
    """One request for each document: a raw prompt to ``/api/generate``; where the service does not know that, refuses it, or
    answers with something else than JSON, the same as a chat to ``/api/chat``. Any other failure is an error at once."""
    root, options = base.rstrip("/"), {"temperature": 0.0, "num_predict": 8}

    def one(query: str, document: str) -> float:
        common = {"model": model, "stream": False, "keep_alive": "30m", "options": options}
        try:
            answer = post(f"{root}/api/generate", common | {"prompt": generate_prompt(query, document, instruction), "raw": True}, timeout)
        except urllib.error.HTTPError as e:
            if e.code not in (400, 404):
                raise ServiceError(f"the reranker answered {e.code}") from e
            answer = None
        except json.JSONDecodeError:
            answer = None
        if not isinstance(answer, dict):
            turns = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": pair_prompt(query, document, instruction)}]
            answer = post(f"{root}/api/chat", common | {"messages": turns, "think": False}, timeout)
        if not isinstance(answer, dict):
            raise ServiceError("the reranker did not answer with an object")
        return answered_score(answer)

    return lambda query, documents: checked_scores([one(query, d) for d in documents], len(documents))


def load_encoder(models: Sequence[str] = ENCODER_MODELS, instruction: str = RERANK_INSTRUCTION):
    """The first of ``models`` that the optional library can load."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError as e:
        raise ServiceError("sentence_transformers is not installed") from e
    failed: Exception | None = None
    for model in models:
        options = {"trust_remote_code": True, "max_length": MAX_LENGTH}
        try:
            try:
                return CrossEncoder(model, prompts={"query": instruction}, default_prompt_name="query", **options)
            except TypeError:  # a version of the library without prompts
                return CrossEncoder(model, **options)
        except (OSError, RuntimeError, ValueError) as e:
            failed = e
    raise ServiceError(f"no reranker could be loaded: {' '.join(str(failed).split())[:180]}")


def encoder_scorer(encoder=None, predict: Callable | None = None, *, instruction: str = RERANK_INSTRUCTION) -> Scorer:
    """All pairs at once through ``predict``, that of ``encoder``, or that of a model which is loaded when first needed. The
    call has as many of the usual options as ``predict`` takes."""
    calls = [{"prompt": instruction, "show_progress_bar": False, "convert_to_numpy": True}, {"show_progress_bar": False}, {}]
    held = {"predict": predict or getattr(encoder, "predict", None)}

    def score(query: str, documents: Sequence[str]) -> list[float]:
        if not documents:
            return []
        if held["predict"] is None:
            if encoder is not None:
                raise ServiceError("the encoder has no predict")
            held["predict"] = load_encoder(instruction=instruction).predict
        pairs = [(query or "", d or "") for d in documents]
        for options in calls:
            try:
                return checked_scores(held["predict"](pairs, **options), len(pairs))
            except TypeError:
                if not options:
                    raise
        raise ServiceError("unreachable")

    return score


def scorer(backend: str, *, url: str = "http://127.0.0.1:11434", model: str | None = None, instruction: str = RERANK_INSTRUCTION) -> Scorer | None:
    """The scorer of a backend's name; none for ``off``."""
    if backend not in BACKENDS:
        raise ValueError(f"a reranker is one of {', '.join(BACKENDS)}")
    if backend == "off":
        return None
    return service_scorer(url, model or SERVICE_MODEL, instruction=instruction) if backend == "ollama" else encoder_scorer(instruction=instruction)


# --- labels ---------------------------------------------------------------------------------------


def rerank_mode(enabled: bool, live: bool, said: str | None = None) -> str:
    """``none`` without a reranker, what the retrieval said, else ``crossencoder`` for live scores and ``fail_open`` without."""
    if not enabled:
        return "none"
    return said if said in ("crossencoder", "fail_open", "none", "off") else "crossencoder" if live else "fail_open"


def rerank_note(mode: str) -> str:
    """One sentence for each mode, on what orders the citations."""
    if mode in ("crossencoder", "live"):
        return "Scores of the reranker are in rerank; citations are in their order, highest first."
    if mode in ("none", "off"):
        return "No reranker; citations are in the order of rrf."
    return "The reranker failed; rerank is null, citations are in the order of rrf, and no scores are claimed."


def error_label(error: BaseException) -> str:
    """What went wrong with a generator, by fixed names."""
    refused = (61, 111, 10061)
    if isinstance(error, ServiceError) and error.__cause__ is not None:
        error = error.__cause__
    if isinstance(error, TimeoutError):
        return "lm_studio_timeout"
    if isinstance(error, urllib.error.HTTPError):
        try:
            text = error.read().decode(errors="replace").lower()
        except (OSError, ValueError, AttributeError, KeyError):
            text = ""
        return "wrong_model" if error.code in (400, 404) or "model" in text or "not found" in text else "lm_studio_http"
    reason = getattr(error, "reason", error)
    if isinstance(reason, TimeoutError):
        return "lm_studio_timeout"
    closed = isinstance(reason, ConnectionRefusedError) or getattr(reason, "errno", None) in refused
    return "port_closed" if closed else "lm_studio_unreachable"
