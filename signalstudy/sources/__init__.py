"""Sources of panels."""
