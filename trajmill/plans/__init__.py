"""Whole stages composed of operators, each one lazy plan."""
