"""Readers of source trees and pages."""
