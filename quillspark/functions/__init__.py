"""Column functions shared by operators, in one place for users."""

from quillspark.operators.incidents import argument_errors, incident_class, tight, verdict
from quillspark.operators.numeric import noise, objective, slope
from quillspark.operators.pages import canonical, cleaned, eligibility, path_number, title
from quillspark.operators.splits import assign, available, boundary
from quillspark.operators.stats import delta_label, rho_label
from quillspark.operators.texts import controls, normalized, plain_layout, repaired
from quillspark.operators.tokens import char_ids, words
from quillspark.operators.windows import draw

__all__ = [
    "argument_errors", "assign", "available", "boundary", "canonical", "char_ids", "cleaned", "controls", "delta_label", "draw", "eligibility", "incident_class",
    "noise", "normalized", "objective", "path_number", "plain_layout", "repaired", "rho_label", "slope", "tight", "title", "verdict", "words",
]
