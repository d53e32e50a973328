"""Settings of the engine, with the names and defaults of its properties."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from enum import IntEnum


class Service(IntEnum):
    """How transactions are routed and run."""

    REPLICATED = 0
    READ_WRITE_SETS = 1
    COST_ROUTED = 2
    FUSED_REBALANCED = 3
    LOCAL_FIRST = 4
    LOCAL_FIRST_FUSED = 5


class Migration(IntEnum):
    """How data moves while transactions run."""

    STOP_AND_COPY = 0
    SOURCE_ONLY = 1
    ON_DEMAND = 2
    CRABBING = 3


class Planning(IntEnum):
    """How a new placement is found."""

    CLUMPS = 0


class Role(IntEnum):
    ACTIVE = 0
    PASSIVE = 1
    IGNORE = 2


#: Procedure numbers kept for control calls.
START_MIGRATION, END_MIGRATION, PHASE_CHANGE, PUSH_ONE, PUSH_TWO = -101, -102, -103, -104, -105
#: The procedure number of a call that does nothing, and the client number of calls that the engine makes itself.
NO_OPERATION, OWN_CLIENT = -(1 << 31), -1


@dataclass(frozen=True)
class Config:
    service: Service = Service.REPLICATED
    partitions: int = 4
    stand_alone_sequencer: bool = False
    batch_size: int = 10
    send_batch_size: int = 1
    send_wait_ms: int = 1000
    routing_beta: float = 1.0
    imbalance_tolerance: float = 0.25
    fusion_size: int = 100_000
    dispatchers: int = 1
    enable_migration: bool = False
    migration: Migration = Migration.CRABBING
    planning: Planning = Planning.CLUMPS
    migration_start_ms: int = 180_000
    monitor_ms: int = 60_000
    chunk_keys: int = 40_000
    chunk_bytes: int = 1_000_000
    chunk_by_bytes: bool = False
    two_phase_push: bool = True
    pipelined_push: bool = True
    push_delay_ms: int = 0
    caught_up: bool = True
    caught_up_delay_ms: int = 105_000
    multi_part_cost: float = 1.0
    overload: float = 1.3
    look_ahead: int = 5
    clump_size: int = 20
    most_clumps: int = 5000
    log_requests: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "service", Service(self.service))
        object.__setattr__(self, "migration", Migration(self.migration))
        object.__setattr__(self, "planning", Planning(self.planning))
        if self.chunk_by_bytes:
            raise ValueError("chunks are sized by keys; sizing by bytes isn't supported")
        if self.partitions < 1 or self.batch_size < 1 or self.dispatchers < 1:
            raise ValueError("partitions, batch_size and dispatchers are positive")

    @property
    def batched(self) -> bool:
        """Whether the service routes whole batches."""
        return self.service in (Service.COST_ROUTED, Service.FUSED_REBALANCED)

    @property
    def fused(self) -> bool:
        """Whether written records stay where they were written."""
        return self.service in (Service.FUSED_REBALANCED, Service.LOCAL_FIRST_FUSED)

    @classmethod
    def from_properties(cls, properties: Mapping[str, str]) -> Config:
        """From texts by field name; unknown names are errors."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := set(properties) - set(kinds):
            raise ValueError(f"no such setting: {sorted(unknown)[0]}")

        def value(name: str, text: str):
            kind = kinds[name]
            if kind == "bool":
                if text.lower() not in ("true", "false"):
                    raise ValueError(f"{name} is true or false")
                return text.lower() == "true"
            return float(text) if kind == "float" else int(text)

        return cls(**{k: value(k, v) for k, v in properties.items()})
