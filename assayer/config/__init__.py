from .defaults import SHARED, default_registry
from .model import (
    Alias,
    Concept,
    DomainProfile,
    Group,
    OutcomeRule,
    PhaseRule,
    Pick,
    Registry,
    SharedRules,
    Specimen,
    Template,
)
from .policy import DEFAULT_POLICY, Policy

__all__ = [
    "Alias",
    "Concept",
    "DEFAULT_POLICY",
    "DomainProfile",
    "Group",
    "OutcomeRule",
    "PhaseRule",
    "Pick",
    "Policy",
    "Registry",
    "SHARED",
    "SharedRules",
    "Specimen",
    "Template",
    "default_registry",
]
