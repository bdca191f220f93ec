"""Operators that take more than one DataFrame call: quantified paths and nearest neighbours."""
