"""Deterministic stand-ins for model clients: no network, results are plain formulas."""

from __future__ import annotations


def responder(system_prompt: str, question: str) -> dict:
    if len(question) % 17 == 0:
        raise RuntimeError("429 rate limit reached")
    if len(question) % 13 == 0:
        raise ValueError("invalid request")
    return {
        "response": f"Answer: {question}",
        "latency_seconds": (len(question) % 40) / 4,
        "input_tokens": len(system_prompt) + len(question),
        "output_tokens": len(question),
        "model_id": "gpt-4o-mini-stub",
    }


def busy_responder(test_id: int, question: str, attempt: int) -> tuple[str]:
    """Up to three refusals for a passing reason, by the test; some questions are never answered."""
    if len(question) % 13 == 0:
        raise ValueError("invalid request")
    if attempt <= test_id % 4:
        raise RuntimeError("429 rate limit reached")
    return (f"Answer {attempt}: {question}",)


def judge(question: str, response: str, criterion: str, prompt: str) -> tuple[float, str]:
    if len(response) % 19 == 0:
        raise ValueError("judge gave no answer")
    return (len(response) + 7 * len(criterion)) % 101 / 100, f"Read {len(response)} characters"


def dimension_judge(question: str, response: str, criterion: str, dimension: str, asked: str) -> float:
    if dimension == "Accuracy" and len(response) % 11 == 0:
        raise ValueError("judge gave no answer")
    return 1.0 if (len(response) + len(asked)) % 3 else 0.0


def safety_judge(metric: str, question: str, response: str, context: str = "") -> tuple[float, str]:
    if (len(response) + len(metric)) % 23 == 0:
        raise ValueError("judge gave no answer")
    return (len(response) * 3 + len(metric) + len(context)) % 1000 / 1000, ""


def improver(prompt: str) -> str:
    return f"Improved from {len(prompt)} characters"


def summarizer(prompt: str) -> str:
    return f"Changes in {len(prompt)} characters"
