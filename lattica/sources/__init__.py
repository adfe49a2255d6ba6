"""Reading, writing, generating and drawing matrices."""
