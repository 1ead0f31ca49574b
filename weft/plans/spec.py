"""Sampling plans: what to sample from a graph, hop by hop.

    plan = SpecBuilder(schema).seed("customer").sample("placed", 10).sample("contains", 5, TOP_K).build()

A plan is a seed op and sampling ops, each of which takes the union of its inputs' nodes and follows one
edge set. Ops are named by what they do unless they're given a name: ``SEED->x``, ``a->b``, ``(x|y)->b``,
with ``.2``, ``.3`` added to repeated names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from weft.schema import GraphSchema, aux_prefix

UNIFORM, TOP_K, WEIGHTED, LATEST = "RANDOM_UNIFORM", "TOP_K", "RANDOM_WEIGHTED", "LATEST_K"
STRATEGIES = (UNIFORM, TOP_K, WEIGHTED, LATEST)


@dataclass(frozen=True)
class SeedOp:
    op_name: str
    node_set: str


@dataclass(frozen=True)
class SamplingOp:
    op_name: str
    input_ops: tuple[str, ...]
    edge_set: str
    size: int
    strategy: str = UNIFORM


@dataclass(frozen=True)
class SamplingSpec:
    seed: SeedOp
    ops: tuple[SamplingOp, ...] = ()
    #: A second seed for links: their targets' node set.
    target_seed: SeedOp | None = None

    def check_order(self) -> None:
        """Raise unless every input is defined before it's used."""
        known = {self.seed.op_name} | ({self.target_seed.op_name} if self.target_seed else set())
        for op in self.ops:
            if missing := [x for x in op.input_ops if x not in known]:
                raise ValueError(f"{op.op_name} uses {missing} before they're defined")
            if op.op_name in known:
                raise ValueError(f"{op.op_name} is defined twice")
            if op.strategy not in STRATEGIES:
                raise ValueError(f"no strategy {op.strategy}")
            known.add(op.op_name)


def topological_order(inputs: dict[str, Sequence[str]]) -> list[str]:
    """Names so that each comes after its inputs; among those that could, first come first. Raises on a cycle."""
    left, out = dict(inputs), []
    while left:
        ready = [n for n, x in left.items() if all(i not in left for i in x)]
        if not ready:
            raise ValueError(f"a cycle among {sorted(left)}")
        for n in ready:
            out.append(n)
            del left[n]
    return out


@dataclass(eq=False)
class Step:
    """A point in a plan: nodes of one node set reached so far."""

    builder: SpecBuilder
    node_set: str
    inputs: tuple[Step, ...] = ()
    edge_set: str = ""
    size: int = 0
    strategy: str = UNIFORM
    name: str = ""

    def sample(self, edge_set: str | Sequence[str], size: int | Sequence[int], strategy: str = UNIFORM, op_name: str = "") -> Step:
        """Follow an edge set; lists of edge sets and sizes make one hop after another."""
        edges = [edge_set] if isinstance(edge_set, str) else list(edge_set)
        sizes = [size] * len(edges) if isinstance(size, int) else list(size)
        if isinstance(edge_set, str) and not isinstance(size, int):
            edges = edges * len(sizes)
        if len(edges) != len(sizes):
            raise ValueError("as many sizes as edge sets")
        return self.builder._extend((self,), edges, sizes, strategy, op_name)

    def merge_then_sample(self, others: Sequence[Step], edge_set: str, size: int, strategy: str = UNIFORM, op_name: str = "") -> Step:
        return Join([self, *others]).sample(edge_set, size, strategy, op_name)

    def build(self) -> SamplingSpec:
        return self.builder.build()


class Join:
    """Several steps that reached the same node set, as one input."""

    def __init__(self, steps: Sequence[Step]) -> None:
        if len({s.node_set for s in steps}) != 1:
            raise ValueError("joined steps must be at one node set")
        self.steps = tuple(steps)

    def sample(self, edge_set: str, size: int, strategy: str = UNIFORM, op_name: str = "") -> Step:
        return self.steps[0].builder._extend(self.steps, [edge_set], [size], strategy, op_name)


@dataclass(eq=False)
class SpecBuilder:
    schema: GraphSchema
    strategy: str = UNIFORM
    steps: list[Step] = field(default_factory=list)

    def seed(self, node_set: str = "", op_name: str = "") -> Step:
        if any(not s.inputs for s in self.steps):
            raise ValueError("a plan has one seed")
        if not node_set:
            if len(self.schema.node_sets) != 1:
                raise ValueError("name the seed's node set")
            node_set = next(iter(self.schema.node_sets))
        if node_set not in self.schema.node_sets:
            raise ValueError(f"no node set {node_set}")
        self.steps.append(Step(self, node_set, name=op_name))
        return self.steps[-1]

    def _extend(self, inputs: tuple[Step, ...], edges: list[str], sizes: list[int], strategy: str, name: str) -> Step:
        for edge_set, size in zip(edges, sizes, strict=True):
            e = self.schema.edge_sets.get(edge_set)
            if e is None:
                raise ValueError(f"no edge set {edge_set}")
            if e.source != inputs[0].node_set:
                raise ValueError(f"{edge_set} starts at {e.source}, not {inputs[0].node_set}")
            if size <= 0:
                raise ValueError("sizes are positive")
            step = Step(self, e.target, inputs, edge_set, size, strategy or self.strategy, name)
            self.steps.append(step)
            inputs, name = (step,), ""
        return inputs[0]

    def build(self) -> SamplingSpec:
        if not self.steps:
            raise ValueError("a plan starts with a seed")
        number = {str(i): s for i, s in enumerate(self.steps)}
        by = {id(s): k for k, s in number.items()}
        names: dict[int, str] = {}
        used: dict[str, int] = {}
        ops, seed = [], None
        for k in topological_order({k: [by[id(i)] for i in s.inputs] for k, s in number.items()}):
            s = number[k]
            if not s.inputs:
                base = s.name or f"SEED->{s.node_set}"
            else:
                sets = [i.node_set if not i.inputs else i.edge_set for i in s.inputs]
                base = s.name or (f"{sets[0]}->{s.node_set}" if len(sets) == 1 else f"({'|'.join(sets)})->{s.node_set}")
            used[base] = used.get(base, 0) + 1
            names[id(s)] = base if used[base] == 1 else f"{base}.{used[base]}"
            if s.inputs:
                ops.append(SamplingOp(names[id(s)], tuple(names[id(i)] for i in s.inputs), s.edge_set, s.size, s.strategy))
            else:
                seed = SeedOp(names[id(s)], s.node_set)
        spec = SamplingSpec(seed, tuple(ops))
        spec.check_order()
        return spec


def spec_tree(schema: GraphSchema, seed: str, sizes: Sequence[int], strategy: str = UNIFORM) -> SamplingSpec:
    """All edge sets out of the seed set, level by level, by name; auxiliary sets are left out."""
    builder = SpecBuilder(schema, strategy)
    level = [builder.seed(seed)]
    for size in sizes:
        level = [s.sample(n, size, strategy) for s in level for n in sorted(schema.edge_sets) if aux_prefix(n) is None and schema.edge_sets[n].source == s.node_set]
    return builder.build()
