"""Thicket: histogram gradient-boosted trees and their analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
