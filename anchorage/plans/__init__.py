"""From facts to requirements, constraints, evidence, findings, a verdict and a report."""
