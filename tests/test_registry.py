import types

import pytest
from pyspark.sql import types as T

from palimpsest.operators.migrate import MigrationEngine
from palimpsest.plans.registry import DuplicateDiscriminatorError, InvalidTargetMigratorError, Policy, Registry, RegistryError, Versioned, migration

S = {"name": T.StringType()}
A, B, C = Versioned("A", S), Versioned("B", S), Versioned("C", S)


def edge(s):
    return s


def test_duplicate_edge_fails_when_configured():
    with pytest.raises(RegistryError, match="Duplicate migrator registration"):
        Registry().register(A, B, edge).register(A, B, edge)


def test_duplicate_discriminator_fails_on_first_use():
    one, two = Versioned("One", S, discriminator="x"), Versioned("Two", S, discriminator="x")
    registry = Registry().register(one, B, edge).register(two, B, edge)
    with pytest.raises(DuplicateDiscriminatorError, match="Duplicate type discriminator") as e:
        MigrationEngine(registry).plan(B)
    assert e.value.sources == (one, two)


def test_external_contract_on_a_versioned_type():
    with pytest.raises(InvalidTargetMigratorError, match="IMigrateFrom<.*RegisterMigrator"):
        MigrationEngine(Registry()).plan(Versioned("V", S, external=object()))


def test_polymorphic_missing_schema_and_missing_source_edge():
    with pytest.raises(RegistryError, match="polymorphic"):
        MigrationEngine(Registry()).plan(Versioned("V", S, polymorphic=True))
    with pytest.raises(RegistryError, match="No JSON metadata is available"):
        MigrationEngine(Registry()).plan(Versioned("V", None))
    with pytest.raises(RegistryError, match="undiscriminated source"):
        MigrationEngine(Registry()).plan(Versioned("V", S, undiscriminated_source=A))


def test_register_all_scan_and_resolver():
    class Both:
        @migration(A, B)
        def ab(self, s):
            return s

        @migration(B, C)
        def bc(self, s):
            return s

    assert len(Registry().register_all(Both)._edges) == 2
    with pytest.raises(RegistryError, match="does not implement any IMigrate<,> contracts"):
        Registry().register_all(object())
    with pytest.raises(RegistryError, match="not assignable"):
        Registry(resolver=lambda cls: 5).register_all(Both)
    module = types.ModuleType("m")

    @migration(A, C)
    def ac(s):
        return s

    class NeedsArgument:
        def __init__(self, x):
            pass

        @migration(C, A)
        def ca(self, s):
            return s

    Both.__module__ = NeedsArgument.__module__ = "m"
    module.ac, module.Both, module.NeedsArgument = ac, Both, NeedsArgument
    assert set(Registry().scan(module)._edges) == {(A, B), (B, C), (A, C)}


def test_metadata_resolution():
    base = Versioned("Base", S, discriminator="base", property_name="kind")
    derived = Versioned("Derived", S, base=base)
    data = Registry(property_name="t").metadata(derived)
    assert (data.discriminator, data.property_name) == ("Derived", "kind")
    marked = Versioned("Marked", S, discriminator="own", marks={"alias": "custom"})
    registry = Registry(property_name="t").discriminator_from(lambda v: v.marks.get("alias"))
    assert (registry.metadata(marked).discriminator, registry.metadata(marked).property_name) == ("custom", "t")
    assert registry.metadata(base).discriminator == "base"
    assert Registry.element_metadata(marked).discriminator == "own" and Registry.element_metadata(A) is None


def test_policy_is_that_of_the_nearest_annotated_type():
    top = Versioned("Top", S, policy=Policy.NULL)
    plain = Versioned("Plain", S, base=top)
    silent = Versioned("Silent", S, discriminator="x", base=top)
    registry = Registry(policy=Policy.FALL_BACK)
    assert registry.policy_of(plain) is Policy.NULL and registry.policy_of(silent) is Policy.FALL_BACK


@pytest.mark.parametrize("bad", ["", "  ", None])
def test_blank_property_name(bad):
    with pytest.raises(RegistryError):
        Registry().set_property_name(bad)


def test_undefined_policy_and_null_for_value_types():
    with pytest.raises(RegistryError):
        Registry().set_policy("throw")
    with pytest.raises(RegistryError, match="value type"):
        MigrationEngine(Registry()).plan(Versioned("V", S, policy=Policy.NULL, value_type=True))
