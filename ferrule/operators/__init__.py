"""Operators on matrices, orderings, trees and factors."""
