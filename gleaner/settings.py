"""What a user can set: defaults, and the environment (GLEANER_<NAME>)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .functions.columns import NOISE_PATTERNS


@dataclass(frozen=True)
class Settings:
    #: Characters of a chunk, and those that it shares with the one before.
    chunk_chars: int = 2000
    chunk_overlap: int = 200
    #: Files that one batch of an ingest takes in.
    ingest_batch: int = 1000
    #: Size of the vectors of the stand-in embedder.
    embed_size: int = 768
    #: Paths that explore leaves out.
    noise_patterns: tuple[str, ...] = NOISE_PATTERNS
    #: Strategies that aren't drawn unless they are asked for.
    disabled_strategies: tuple[str, ...] = ()
    #: How a score moves a posterior: by itself ("pseudo_count"), or as the
    #: chance of a whole win ("bernoulli").
    bandit_mode: str = "pseudo_count"
    #: Whether findings are checked against a source before they are kept.
    grounding: bool = False
    #: Attempts and first wait (seconds) of a model call that fails for now.
    attempts: int = 3
    wait: float = 1.0
    #: Model calls whose answers are committed at once, and those of a task.
    call_batch: int = 2000
    call_task: int = 20
    #: Texts that an embedder is asked for at once, and the pause between
    #: (seconds); the stand-in isn't paced.
    embed_batch: int = 20
    embed_pause: float = 1.0
    #: For the command line: module:function that makes the completer, and the
    #: embedder.
    completer: str = ""
    embedder: str = ""
    #: Entities that one run of synthesize works on at most.
    synthesis_budget: int = 500
    #: Mentions that one prompt of synthesize holds.
    prompt_mentions: int = 200
    #: The answer search: nodes below the root, rounds, exploration.
    answer_depth: int = 5
    answer_iterations: int = 20
    uct: float = 1.41
    #: Bytes from which a table's vectors have an index, and how many of its cells
    #: a search reads (0: as many as the exact result needs).
    vector_index_bytes: int = 64 << 20
    vector_probes: int = 0
    #: Seconds that files of tables stay when newer versions don't need them.
    retain: float = 3600.0
    #: What the corpus is about, put before every instruction to a model.
    domain: str = ""

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """Lists are separated by commas; 1, true, yes and on are true."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(Settings):
            raw = env.get(f"GLEANER_{f.name.upper()}")
            if raw is None:
                continue
            default = f.default
            if isinstance(default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                found[f.name] = type(default)(raw)
        return Settings(**found)

    def told(self, instruction: str) -> str:
        """An instruction with the domain before it."""
        return f"{self.domain}\n\n{instruction}" if self.domain else instruction
