"""The policies of the training-data system, as plain values and as small dimension tables.

Fixed values throughout: lanes, role bounds, packing policies, curriculum stages, thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SEED = 1337
SPECIALS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
PAD, BOS, EOS = 0, 1, 2
VOCAB_SIZE = 512
SEQ_LEN = 128
JACCARD = 0.8
ROLE_BOUNDS = (("TRAIN", 700), ("VALIDATION", 800), ("EVAL", 900), ("PROXY", 1000))
ROLES = ("TRAIN", "VALIDATION", "EVAL", "PROXY", "QUARANTINE")
LANES = (("verified-web", "verified", "web"), ("verified-speech", "verified", "speech"), ("verified-pdf", "verified", "pdf"), ("unverified", "unverified", None), ("synthetic", "synthetic", None))
VERIFIED = ("verified-web", "verified-speech", "verified-pdf")
EXACT_GROUP = 18


@dataclass(frozen=True)
class Packing:
    split: bool
    max_docs: int
    group: int


PACKING = {
    "verified-web": Packing(False, 8, 16),
    "verified-speech": Packing(False, 12, 18),
    "verified-pdf": Packing(True, 4, 12),
    "unverified": Packing(True, 6, 14),
    "synthetic": Packing(True, 6, 14),
}
ROLE_AGNOSTIC = Packing(True, 6, 14)


@dataclass(frozen=True)
class Stage:
    name: str
    weights: dict[str, float] = field(default_factory=dict)
    min_steps: int = 8


STAGES = (
    Stage("stage1_verified_only", {"verified-web": 0.45, "verified-speech": 0.25, "verified-pdf": 0.30}),
    Stage("stage2_plus_unverified", {"verified-web": 0.35, "verified-speech": 0.20, "verified-pdf": 0.20, "unverified": 0.25}),
    Stage("stage3_plus_synthetic", {"verified-web": 0.28, "verified-speech": 0.17, "verified-pdf": 0.15, "unverified": 0.20, "synthetic": 0.20}),
)
FLOOR_SHARE, FLOOR_WINDOW, FLOOR_LEAST = 0.30, 16, 4
ADVANCE_STEPS, ADVANCE_EPS = 8, 0.01
POOL, SCORE_EVERY, SKETCH, TEMPERATURE = 24, 4, 64, 0.5
ACCEPT, BAND, MAX_DEFERS = 0.0, 0.15, 3
ROLLBACK_MARGIN, DEMOTION = 0.02, 0.5
BATCH = 4
