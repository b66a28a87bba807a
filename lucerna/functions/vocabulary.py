"""Names, labels, word lists and patterns that answers are read by, in their usual order."""

STRATEGIES = ["da", "ras", "ctl", "sc"]
LABELS = ["ANSWER", "JUSTIFICATION", "KEY REASONING", "UNCERTAINTY", "CONFIDENCE", "RATIONALE"]
STRATEGY_LABELS = {
    "da": ["ANSWER", "JUSTIFICATION"],
    "ras": ["ANSWER", "KEY REASONING", "UNCERTAINTY", "CONFIDENCE"],
    "ctl": ["ANSWER", "RATIONALE"],
    "sc": ["ANSWER", "JUSTIFICATION"],
}
CHOICE_TYPES = ["mcq-4-choices", "mcq-2-choices"]
TRUTH_TYPE = "true_or_false"
OPEN_TYPES = ["open-ended-qa", "relation_extraction", "filling"]
DOMAINS = ["Biology", "Chemistry", "Material", "Physics"]
LEVELS = ["L1", "L2", "L3", "L4", "L5"]
EXAMPLE_LEVELS = ["L1", "L3", "L5", "L2", "L4"]

TRUTH_WORDS = {"yes": "Yes", "true": "Yes", "correct": "Yes", "right": "Yes", "no": "No", "false": "No", "incorrect": "No", "wrong": "No"}
REFUSALS = [
    r"I\s+cannot", r"I'm\s+unable", r"I\s+don't\s+have\s+(?:enough|sufficient)", r"as an AI", r"I\s+apologize",
    r"I\s+can't\s+(?:answer|provide)", r"I\s+am\s+not\s+able", r"I\s+do\s+not\s+have",
]
CITED = ["[Pp]assage", "[Ss]ource"]
LAST_PASSAGE = 10
CHINESE_ANSWER, CHINESE_REASON, CHINESE_CONFIDENCE = ["答案", "回答"], ["理由", "解释", "说明", "推理"], ["置信度", "信心"]
CHINESE_OTHER = ["不确定"]
CHINESE_SHARE = 0.3
FUZZY_SHARE = 0.8
QUORUM, SAMPLES, CHECKPOINT_EVERY = 3, 5, 500
