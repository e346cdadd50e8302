"""Regression grids: specs, design, lockstep fits, diagnostics and effects."""
