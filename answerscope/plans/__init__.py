"""Configuration, schemas, and how metric tables follow from the inputs."""
