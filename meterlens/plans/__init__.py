"""Plans that put operators together: scoring, evaluation, learning."""
