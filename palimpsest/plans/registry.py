"""Versioned types, migration edges, and how they resolve. All of it lives on the driver; only expressions reach executors."""

from __future__ import annotations

import enum
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

from pyspark.sql import types as T

DEFAULT_PROPERTY = "$type"


class Policy(enum.Enum):
    """What a failed migration gives."""

    THROW = "throw"
    FALL_BACK = "fall_back_to_target_type"
    NULL = "return_null"


class RegistryError(ValueError):
    """A configuration that can't be used."""


class DuplicateDiscriminatorError(RegistryError):
    def __init__(self, target: "Versioned", discriminator: str, first: "Versioned", second: "Versioned"):
        super().__init__(f"Duplicate type discriminator '{discriminator}' for target '{target.name}': sources '{first.name}' and '{second.name}'.")
        self.target, self.discriminator, self.sources = target, discriminator, (first, second)


class InvalidTargetMigratorError(RegistryError):
    def __init__(self, target: "Versioned"):
        super().__init__(f"'{target.name}' implements the external contract itself. Use IMigrateFrom<source> on the target, or RegisterMigrator with another class.")
        self.target = target


@dataclass(frozen=True)
class Listed:
    """A list of a versioned type."""

    item: "Versioned"


@dataclass(frozen=True)
class Mapped:
    """A map from strings to a versioned type."""

    item: "Versioned"



@dataclass(eq=False)
class Versioned:
    """One version of a payload.

    ``shape`` is a dict of members for objects, or a Spark type, Listed or Mapped for other JSON values. ``discriminator`` and
    ``property_name`` are what the type declares itself; the property name and the policy are inherited from ``base``, the
    discriminator is not.
    """

    name: str
    shape: Any
    discriminator: str | None = None
    property_name: str | None = None
    policy: Policy | None = None
    undiscriminated_source: "Versioned | None" = None
    tracked: bool = False
    value_type: bool = False
    base: "Versioned | None" = None
    annotated: bool | None = None
    marks: dict[str, Any] = field(default_factory=dict)
    polymorphic: bool = False
    external: Any = None
    after_decode: Callable | None = None
    own_edges: dict["Versioned", Callable] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.annotated is None:
            self.annotated = any(x is not None for x in (self.discriminator, self.property_name, self.policy, self.undiscriminated_source))
        if self.policy is not None and not isinstance(self.policy, Policy):
            raise RegistryError(f"Undefined failure policy: {self.policy!r}")

    def migrates_from(self, source: "Versioned") -> Callable:
        """Decorator for an edge that the target owns."""

        def add(fn: Callable) -> Callable:
            self.own_edges[source] = fn
            return fn

        return add

    @property
    def kind(self) -> str:
        """object, array, map or scalar."""
        if isinstance(self.shape, dict | T.StructType):
            return "object"
        if isinstance(self.shape, Listed | T.ArrayType):
            return "array"
        if isinstance(self.shape, Mapped | T.MapType):
            return "map"
        return "scalar"

    def members(self) -> dict[str, Any]:
        if isinstance(self.shape, T.StructType):
            return {f.name: f.dataType for f in self.shape.fields}
        return self.shape if isinstance(self.shape, dict) else {}

    def lineage(self) -> list["Versioned"]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.base
        return out


@dataclass(frozen=True)
class Metadata:
    type: Versioned
    discriminator: str
    property_name: str
    undiscriminated_source: Versioned | None


@dataclass(frozen=True)
class Edge:
    source: Versioned
    target: Versioned
    apply: Callable
    metadata: Metadata
    owned: bool


def migration(source: Versioned, target: Versioned) -> Callable:
    """Decorator for a function or method that is an edge; ``register_all`` and ``scan`` find it."""

    def add(fn: Callable) -> Callable:
        fn.__migrates__ = [*getattr(fn, "__migrates__", []), (source, target)]
        return fn

    return add


def _blank(text: str | None) -> bool:
    return text is None or not text.strip()


class Registry:
    """Edges and defaults. Metadata is resolved when a target is first used, so the order of configuration calls is free."""

    def __init__(self, property_name: str = DEFAULT_PROPERTY, policy: Policy = Policy.THROW, resolver: Callable[[type], Any] | None = None):
        self._edges: dict[tuple[Versioned, Versioned], Callable] = {}
        self._discriminators: list[Callable[[Versioned], str | None]] = []
        self._resolver = resolver
        self.set_property_name(property_name)
        self.set_policy(policy)

    def set_property_name(self, name: str) -> "Registry":
        if _blank(name):
            raise RegistryError("The discriminator property name cannot be null or empty")
        self.property_name = name
        return self

    def set_policy(self, policy: Policy) -> "Registry":
        if not isinstance(policy, Policy):
            raise RegistryError(f"Undefined failure policy: {policy!r}")
        self.policy = policy
        return self

    def discriminator_from(self, selector: Callable[[Versioned], str | None]) -> "Registry":
        """Another source of discriminators, such as a mark of the type; None falls through to the declared one."""
        self._discriminators.append(selector)
        return self

    def register(self, source: Versioned, target: Versioned, fn: Callable) -> "Registry":
        if (source, target) in self._edges:
            raise RegistryError(f"Duplicate migrator registration for '{source.name}' to '{target.name}'.")
        self._edges[source, target] = fn
        return self

    def register_all(self, provider: Any) -> "Registry":
        """Every edge of an object, or of a class, which the resolver or else its constructor makes an instance of."""
        cls = provider if isinstance(provider, type) else type(provider)
        found = [(pair, name) for name, m in inspect.getmembers(cls, callable) for pair in getattr(m, "__migrates__", ())]
        if not found:
            raise RegistryError(f"'{cls.__name__}' does not implement any IMigrate<,> contracts.")
        instance = provider if not isinstance(provider, type) else self._instance(cls)
        for (source, target), name in found:
            self.register(source, target, getattr(instance, name))
        return self

    def _instance(self, cls: type) -> Any:
        made = self._resolver(cls) if self._resolver else None
        if made is None:
            return cls()
        if not isinstance(made, cls):
            raise RegistryError(f"The instance of '{type(made).__name__}' that was resolved is not assignable to '{cls.__name__}'.")
        return made

    def scan(self, *modules: ModuleType) -> "Registry":
        """Every edge defined in the modules: functions, and concrete classes. Classes that can't be made are passed over."""
        for module in modules:
            for _, item in inspect.getmembers(module):
                if inspect.isfunction(item):
                    for source, target in getattr(item, "__migrates__", ()):
                        self.register(source, target, item)
                elif inspect.isclass(item) and item.__module__ == module.__name__ and not inspect.isabstract(item):
                    if any(getattr(m, "__migrates__", ()) for _, m in inspect.getmembers(item, callable)):
                        try:
                            instance = self._instance(item)
                        except TypeError:
                            continue
                        self.register_all(instance)
        return self

    def metadata(self, kind: Versioned) -> Metadata:
        """Discriminator: the custom source, the type's own declaration, its name. Property: the nearest declaration, the default."""
        custom = next((d for s in self._discriminators if (d := s(kind)) is not None), None)
        declared = next((t.property_name for t in kind.lineage() if t.property_name is not None), None)
        discriminator = custom if custom is not None else kind.discriminator if kind.discriminator is not None else kind.name
        return Metadata(kind, discriminator, declared or self.property_name, kind.undiscriminated_source)

    @staticmethod
    def element_metadata(kind: Versioned) -> Metadata | None:
        """Of list elements and map values, which neither the custom source nor the default property name reach."""
        if not any(t.annotated for t in kind.lineage()):
            return None
        declared = next((t.property_name for t in kind.lineage() if t.property_name is not None), None)
        return Metadata(kind, kind.discriminator if kind.discriminator is not None else kind.name, declared or DEFAULT_PROPERTY, None)

    def policy_of(self, target: Versioned) -> Policy:
        """That of the nearest annotated type, if it set one; annotated types further up don't count."""
        nearest = next((t for t in target.lineage() if t.annotated), None)
        return nearest.policy if nearest is not None and nearest.policy is not None else self.policy

    def edges_to(self, target: Versioned) -> list[Edge]:
        """The target's own edges and the registered ones, own ones first for one source; checked for conflicts."""
        if target.polymorphic:
            raise RegistryError(f"'{target.name}' is polymorphic; polymorphic hierarchies can't be versioned.")
        if target.external is not None:
            raise InvalidTargetMigratorError(target)
        chosen: dict[Versioned, tuple[Callable, bool]] = {s: (fn, False) for (s, t), fn in self._edges.items() if t is target}
        chosen.update({s: (fn, True) for s, fn in target.own_edges.items()})
        edges = [Edge(s, target, fn, self.metadata(s), own) for s, (fn, own) in chosen.items()]
        seen: dict[str, Versioned] = {}
        for e in edges:
            if e.metadata.discriminator in seen:
                raise DuplicateDiscriminatorError(target, e.metadata.discriminator, seen[e.metadata.discriminator], e.source)
            seen[e.metadata.discriminator] = e.source
        wanted = target.undiscriminated_source
        if wanted is not None and wanted not in chosen:
            raise RegistryError(f"'{target.name}' names '{wanted.name}' as undiscriminated source, but no edge migrates it.")
        for t in (target, *chosen):
            if t.shape is None:
                raise RegistryError(f"No JSON metadata is available for type '{t.name}'.")
        return edges
