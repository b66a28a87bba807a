"""Run settings, model look-up and prompt templates; small files on the driver."""

from __future__ import annotations

from pathlib import Path

from ..functions.vocabulary import STRATEGIES

REQUIRED = ("data", "models", "strategies", "inference", "output")
ASK = "{question}\n{options_block}\n\n"
#: Our wording; the slots {question}, {options_block}, {passages_block} and the labels are fixed.
TEMPLATES = {
    "da": ASK + "Write two lines, each after its label.\nANSWER: the choice's letter, or a few words\nJUSTIFICATION: why, in brief",
    "ras": ASK + "Fill in this sheet, a line for each label, and write nothing around it.\nANSWER: the choice's letter, or a few words\nKEY REASONING: what decided it\nUNCERTAINTY: what could overturn it\nCONFIDENCE: low, medium or high",
    "ctl": ASK + "Work it out on your own paper first; hand in two lines only.\nANSWER: the choice's letter, or a few words\nRATIONALE: the argument in brief",
}
PASSAGES = "Excerpts, numbered; put a number in brackets wherever one is used:\n{passages_block}"


def load(path: str, required: tuple[str, ...] = REQUIRED) -> dict:
    """Settings from YAML (JSON where PyYAML isn't installed); raises ValueError naming what is missing."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        import json

        found = json.loads(text)
    else:
        found = yaml.safe_load(text)
    if missing := [k for k in required if k not in (found or {})]:
        raise ValueError(f"settings lack {', '.join(missing)}")
    return found


def model(settings: dict, name: str) -> dict:
    if name not in settings["models"]:
        raise KeyError(f"{name}: known models are {', '.join(settings['models'])}")
    return settings["models"][name]


def template(strategy: str, folder: str | None = None) -> str:
    """The prompt template of a strategy, in either case; repeated sampling uses that of direct answers."""
    name = strategy.lower()
    if name not in STRATEGIES:
        raise ValueError(f"{strategy}: known strategies are {', '.join(STRATEGIES)}")
    name = "da" if name == "sc" else name
    return Path(folder, f"{name}.txt").read_text(encoding="utf-8") if folder else TEMPLATES[name]


def subset(wanted: list[str] | None, known: list[str]) -> list[str]:
    """The wanted names in known order; all without a wish; ValueError for unknown ones."""
    if not wanted:
        return list(known)
    if unknown := [x for x in wanted if x not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [x for x in known if x in wanted]
